import random

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import functions as F

from mediatally.llm import components, simhash

from .data import frame, odd_rows, words


def brute_mark(title):
    found = (title or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i: i + 3]), seed=42) for i in range(max(1, len(found) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def titles():
    rng = random.Random(8)
    rows = []
    for group in range(12):
        base = words(rng, 300)
        for copy in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "edit"
            rows.append((len(rows) + 10, " ".join(own)))
    return rows + odd_rows()


def test_hashes_and_marks_equal_the_library(spark):
    rows = [t for _, t in titles()] + ["A B  c", "x" * 33 + " " + "y" * 64, "q" * 7, "é" * 40]
    assert simhash.fingerprints(pa.array(rows)).tolist() == [brute_mark(t) for t in rows]
    raw = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    n = np.arange(1, 130)
    got = simhash.xxh64(raw, np.arange(len(n)), n)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[i: i + k].tobytes(), seed=42) for i, k in enumerate(n.tolist())]


def brute_classes(marks):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {m: find(m) for m in marks}


def test_trie_join_equals_all_pairs():
    rng = random.Random(1)
    marks = {0}
    for _ in range(40):
        m = rng.getrandbits(64)
        for _ in range(12):
            marks.add(m)
            for _ in range(rng.randint(1, 3)):
                m ^= 1 << rng.randrange(64)
    marks = np.array(sorted(marks), dtype=np.uint64)
    label = simhash.linked_classes(marks, (0, len(marks)), (0, len(marks)), 0)
    want = brute_classes(marks.tolist())
    assert {int(m): int(marks[k]) for m, k in zip(marks, label)} == want


def test_similar_titles_equal_brute_force(spark):
    rows = titles()
    got = simhash.similar_titles(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    marks = {brute_mark(t) for _, t in rows}
    root = brute_classes(marks)
    least = {}
    for i, t in rows:
        r = root[brute_mark(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((str(i), least[root[brute_mark(t)]], brute_mark(t)) for i, t in rows), key=str)
    assert sorted(((str(r.item_id), r.component_id, r.mark % 2**64) for r in got), key=str) == want


def test_keep_one_leaves_one_row_of_each_class(spark):
    rows = titles()
    df = frame(spark, rows)
    of = {r.item_id: r.component_id for r in simhash.similar_titles(frame(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()}
    least = {}
    for k, (i, _) in enumerate(rows):
        place = (i is None, i or 0)
        least[of[k]] = min(least.get(of[k], place), place)
    kept = simhash.keep_one(df).collect()
    assert sorted((r.item_id is None, r.item_id or 0) for r in kept) == sorted(least.values()) and kept[0].asDict().keys() == set(df.columns)


def test_keep_one_keeps_rows_not_ids(spark):
    texts = [" ".join(words(random.Random(s), 40)) for s in (1, 2)]
    rows = [(7, texts[0], "a"), (7, texts[1], "b"), (7, texts[1], "b"), (None, texts[0], "c"), (None, " ".join(words(random.Random(3), 40)), "d"), (9, texts[1], "e")]
    df = spark.createDataFrame(rows, "item_id bigint, title string, row_key string").withColumn("_kept", F.lit(1))
    assert sorted((r.row_key, r._kept) for r in simhash.keep_one(df).collect()) == [("a", 1), ("b", 1), ("d", 1)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1000, 1100)]
    star = [(5, i) for i in range(6, 300)]
    links = spark.createDataFrame(chain + star + [(3, 3)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(1000, 1101), *range(5, 300), 3, 4]], "node bigint")
    got = {r.node: r.root for r in components.smallest_reachable(nodes, links).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1101)}, **{i: 5 for i in range(5, 300)}, 3: 3, 4: 4}


def test_empty_table(spark):
    assert simhash.similar_titles(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0
