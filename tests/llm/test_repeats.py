import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mediatally.llm import repeats

from .data import frame, odd_rows, words


def messages():
    rng = random.Random(6)
    shared = [words(rng, n) for n in (35, 36, 60, 200)]
    rows = []
    for i in range(60):
        own = words(rng, rng.randint(0, 120))
        for part in rng.sample(shared, rng.randint(0, 3)):
            part = list(part)
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            at = rng.randint(0, len(own))
            own[at:at] = part
        rows.append((100 + i, rng.choice([" ", "\n", "  \t"]).join(own)))
    rows += [(300, "again " * 90), (301, "one two three " * 40), (302, " ".join(shared[3][:34])), (303, " ".join(shared[3][:35]))]
    return rows + odd_rows()


def brute(rows):
    split = [(t or "").encode().split() for _, t in rows]
    times = Counter(tuple(w[i: i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, split):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if times[tuple(w[k: k + 35])] > 1:
                gone[k: k + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 300])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    rows = messages()
    got = repeats.drop_repeated_passages(frame(spark, rows, "log_id", "msg")).collect()
    assert sorted((str(r.log_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(r.kept_msg.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_index_counts_runs_like_a_scan():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 499), 0).astype(np.uint8)  # ends like a segment
    index = repeats.FmIndex(text)
    raw = text.tobytes()
    for _ in range(200):
        n = int(rng.integers(1, 12))
        at = int(rng.integers(0, 499 - n))
        run = raw[at: at + n]
        low = index.start[[run[-1]]]
        high = low + np.bincount(text, minlength=256)[[run[-1]]]
        for symbol in reversed(run[:-1]):
            low, high = index.extend(np.array([symbol]), low, high)
        want = sum(raw[i: i + n] == run for i in range(500 - n + 1))
        assert high[0] - low[0] == want


def test_windows_of_segments_cover_each_window_once():
    rows = messages()
    s = repeats.segments_of(pa.array([t for _, t in rows]))
    seen = Counter((int(r), int(f) + k) for r, f, n in zip(s.row, s.first, s.windows) for k in range(n))
    want = Counter((r, k) for r, (_, t) in enumerate(rows) for k in range(len((t or "").encode().split()) - 34))
    assert seen == want and s.windows.max() <= repeats.MOST


def test_empty_table(spark):
    assert repeats.drop_repeated_passages(frame(spark, [], "log_id", "msg")).count() == 0


def test_no_anchor_gathers_the_holders_of_a_hot_passage(spark):
    rng = random.Random(12)
    hot = words(rng, 120)
    own = lambda n: ["".join(rng.choices("abcdefghij", k=9)) for _ in range(n)]
    rows = []
    for i in range(600):
        a, b = (rng.randint(0, 40), rng.randint(80, 120)) if i % 2 else (0, 120)
        rows.append((i, " ".join(own(rng.randint(1, 50)) + (hot[a:b] if i < 400 else []) + own(rng.randint(1, 50)))))
    df = frame(spark, rows, "log_id", "msg")
    frequent, _ = repeats.frequent_parts(df.selectExpr("log_id AS key", "msg"), 16)
    s = repeats.segments_of(pa.array([t for _, t in rows]), frequent.anchors)
    names, checks = repeats.names_of(s)
    known = set(zip(frequent.names.tolist(), frequent.checks.tolist()))
    left = {(int(a), int(r)) for a, r, n, c in zip(s.anchor, s.row, names, checks) if (int(n), int(c)) not in known}
    assert len(known) > 0 and max(Counter(a for a, _ in left).values()) < repeats.FREQUENT
    got = repeats.drop_repeated_passages(df).collect()
    assert sorted((str(r.log_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
