import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mediatally.llm import resampling

from .data import frame, odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, longest=1, buckets=10_000, min_words=20, percent=10, seed="2024"):
    def features(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [" ".join(w[i: i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    of = lambda f: zlib.crc32(f.encode()) % buckets
    have, want = Counter(), Counter()
    for _, t in rows:
        have.update(map(of, features(t)[1]))
    for t in target:
        want.update(map(of, features(t)[1]))
    s, t = sum(have.values()), sum(want.values())
    out = []
    for i, text in rows:
        n, f = features(text)
        gains = [math.floor(1000 * math.log((want[of(x)] + 1) * (s + buckets) / ((have[of(x)] + 1) * (t + buckets)))) for x in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(able) * percent // 100
    for k, r in enumerate(able):
        r.append(k + 1 if k < drawn else None)
    return sorted([tuple(r[:4]) + ((r[5] if len(r) > 5 else None),) for r in out], key=str)


def corpus(seed=4, n=150):
    rng = random.Random(seed)
    common, rare = words(rng, 12), words(rng, 400)
    rows = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randint(0, 60))).title()) for i in range(n)]
    copies = [(n, rows[3][1]), (n, rows[3][1])] + [(None, "Same title " * 12)] * 40 + [(7, "Same title " * 12)] * 5
    target = [" ".join(rng.choices(rare[:60], k=30)) for _ in range(10)] + [None, ""]
    return rows + copies + odd_rows(), target


def drawn(spark, rows, target, **more):
    wanted = spark.createDataFrame([(t, "x") for t in target], "title string, item_id string")
    got = resampling.draw_like(frame(spark, rows).repartition(3), wanted, **more)
    assert got.columns == ["item_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"longest": 3, "buckets": 97, "min_words": 5, "percent": 40, "seed": "x"}], ids=["production", "runs"])
def test_draw_equals_brute_force(spark, more):
    rows, target = corpus()
    assert drawn(spark, rows, target, **more) == brute(rows, target, **more)


def test_head_and_tail_give_the_same_buckets(spark):
    rows, target = corpus(9, 60)
    whole = drawn(spark, rows, target, longest=2)
    assert drawn(spark, rows, target, longest=2, head=1) == whole == drawn(spark, rows, target, longest=2, head=10**6)
    titles = [t.split() for t in (b"a b a b", b"", b"c")]
    full = resampling.Head({w: zlib.crc32(w) for w in (b"a", b"b")}, {b"a b": zlib.crc32(b"a b") % 50})
    for a, b in zip(resampling.features_of(titles, full, 2, 50), resampling.features_of(titles, resampling.Head(), 2, 50)):
        assert np.array_equal(a, b)


def test_head_holds_the_most_frequent_runs(spark):
    items = frame(spark, [(1, "b a b"), (2, "B-a c"), (3, None), (4, "d" * 65 + (" " + "d" * 65) * 9)])
    head = resampling.frequent_runs(items, longest=2, buckets=50, head=2)
    assert head.states == {w: zlib.crc32(w) for w in (b"b", b"a")} and list(head.states) == [b"b", b"a"]
    assert head.runs == {r: zlib.crc32(r) % 50 for r in (b"b a", b"a b")}


def test_empty_sides(spark):
    assert drawn(spark, [], ["a b"]) == []
    rows, _ = corpus(5, 30)
    assert drawn(spark, rows, []) == brute(rows, [])
    assert all(r[4] is None for r in drawn(spark, [(1, "too short")], ["too short"]))
