import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from mediatally.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, rows string, entry string, run string, salt int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "r", "e", "n", 1) for i, v, g in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    width = len(fine[0][1]) // parts if fine else 0
    cut = [[tuple(math.floor(256 * float(np.float32(x))) for x in v[p * width: (p + 1) * width]) for p in range(parts)] for _, v, _ in fine]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[best(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(members[k]) for x in zip(*members[k])) if members[k] else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, per_label = [], defaultdict(int)
    for (i, _, g), c in zip(fine, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        per_label[g] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, g))
    return sorted([(i, c, e, per_label[g], digest) for i, c, e, g in out], key=str)


def sample(n=300, width=32, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(9)]
    rows = [(i * 3, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    bad = [(1, None, 1), (4, [None] + [0.0] * (width - 1), 1), (7, [float("nan")] * width, 2), (10, [float("inf")] * width, None), (11, [1.0] * 5, 1)]
    return rows + bad + [(5000 + i, centres[0], 7) for i in range(200)] + [(3, rows[1][1], 1), (None, rows[2][1], None)]


@pytest.mark.parametrize("more", [{}, {"parts": 4, "entries": 5, "rounds": 3}, {"rounds": 0, "entries": 256}], ids=["production", "few", "start"])
def test_codes_equal_brute_force(spark, more):
    rows = sample()
    got = codes.compress_vectors(vectors(spark, rows).repartition(5), **more)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, **more)


def test_small_and_odd_tables(spark):
    assert codes.compress_vectors(vectors(spark, [])).collect() == []
    assert codes.compress_vectors(vectors(spark, [(1, None, 1), (2, [1.0] * 15, 1)])).collect() == []
    one = [(9, [0.1 * k for k in range(16)], 1)]
    assert [tuple(r) for r in codes.compress_vectors(vectors(spark, one)).collect()] == brute(one)
    none = [(1, [], 1), (2, [], None)]
    assert sorted((r.vec_id, r.code, r.error) for r in codes.compress_vectors(vectors(spark, none)).collect()) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]
    large = [(i, [1e30 * (-1) ** i] * 16, 1) for i in range(3)] + [(9, [300.0] * 16, 2)]
    got = {r.vec_id: (r.code, r.error) for r in codes.compress_vectors(vectors(spark, large), entries=2, rounds=0).collect()}
    assert got[0] == ("00" * 16, 0) and got[1] == ("01" * 16, 0) and got[9][1] > 0
    with pytest.raises(ValueError):
        codes.compress_vectors(vectors(spark, one), entries=300)


def test_nearest_is_exact_in_every_number_type():
    rng = np.random.default_rng(3)
    for largest in (40, 3000, 1 << 26):
        members, entries = rng.integers(-largest, largest, (200, 4)), rng.integers(-largest, largest, (17, 4))
        entries[5] = entries[2]  # a tie goes to the lower index
        index, error = codes.nearest(members.astype(np.int32), entries)
        gap = ((members[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(index, gap.argmin(axis=1)) and np.array_equal(error, gap.min(axis=1)) and 5 not in index


def test_only_members_that_change_their_entry_move(spark):
    rows = [r for r in sample() if r[1] is not None and len(r[1]) == 32]
    kept = codes.usable(vectors(spark, rows).select("vec_id", "embedding", "label"))
    books = codes.first_entries(kept)
    from pyspark.sql.pandas.types import to_arrow_type

    ids, labels = to_arrow_type(kept.schema["vec_id"].dataType), to_arrow_type(kept.schema["label"].dataType)
    cut = kept.mapInArrow(codes._cut(books, ids, labels, 4), f"{codes.BLOCK}, ids array<bigint>, labels array<int>").filter("ids IS NULL")
    resident = cut.select(*codes.BLOCK_NAMES).cache()
    new = codes.updated(books, resident)
    after = codes.migrated(resident, new, 4)
    members = "sum(length(rows)) / 2"
    total, = resident.selectExpr(members).first()
    moved, = after.filter("moved").selectExpr(members).first()
    stayed, = after.filter("NOT moved").selectExpr(members).first()
    assert 0 < moved < stayed and moved + stayed == total
    before = {(r.run, r.position, k): r.entry for r in resident.collect() for k in np.frombuffer(r.rows, "<u2").tolist()}
    for r in after.collect():
        assert all((before[r.run, r.position, k] != r.entry) == r.moved for k in np.frombuffer(r.rows, "<u2").tolist())
    resident.unpersist()
