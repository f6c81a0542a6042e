"""Ordered operators against plain sequential models, with small buckets so that values are carried across them."""

import random
import re

import pytest
from pyspark.sql import Window, functions as F

from mediatally.operators import dedup, items, scan, timeline
from mediatally.operators.scan import Running, every, numbered, running

from conftest import plan_of


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.randrange(2000), i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, ts bigint, id bigint, v bigint").repartition(7)


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_running_matches_a_loop(log, width):
    rows, df = log
    got = running(
        df, keys=["k"], order=["ts", "id"], bucket=every("ts", width), total=Running("sum", F.col("v")),
        before=Running("sum", F.col("v"), exclusive=True), top=Running("max", F.col("v")), n=Running("count", F.col("v")),
        last=Running("last", F.col("v")), prev=Running("last", F.col("v"), exclusive=True), nxt=Running("next", F.col("v")))
    got = {r.id: r for r in got.collect()}
    for k in "abc":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        total, top, n, last = 0, None, 0, None
        for i, (_, _, rid, v) in enumerate(mine):
            r = got[rid]
            assert r.before == total and r.prev == last
            if v is not None:
                total, top, n, last = total + v, v if top is None else max(top, v), n + 1, v
            assert (r.total, r.top, r.n, r.last) == (total, top, n, last)
            assert r.nxt == next((x[3] for x in mine[i + 1:] if x[3] is not None), None)


def greedy(rows, window):
    """rows: (key, ts, id) to the ids kept."""
    last, kept = {}, set()
    for key, ts, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts - last[key] >= window:
            last[key] = ts
            kept.add(rid)
    return kept


def _dedup_case(spark, rows, window, chunk, span=3):
    df = spark.createDataFrame(rows, "k string, ts_ms bigint, request_id bigint").repartition(5)
    got = dedup.dedup_window(df, keys=["k"], window_ms=window, chunk_ms=chunk, span_chunks=span)
    assert {r.request_id for r in got.collect()} == greedy(rows, window)


@pytest.mark.parametrize("seed", range(4))
def test_dedup_sparse_dense_and_mixed(spark, seed):
    rng = random.Random(seed)
    rows, rid = [], 0
    for key, gap in (("sparse", 500), ("dense", 7), ("edge", 60), ("mixed", 0)):
        ts = rng.randrange(100)
        for _ in range(500):
            ts += rng.choice([1, 3, 200]) if key == "mixed" else rng.randrange(0, 2 * gap)
            rows.append((key, ts, rid))
            rid += 1
    _dedup_case(spark, rows, 60, 300, span=1 + seed)


@pytest.mark.parametrize("seed", range(6))
def test_dedup_chunks_shorter_than_the_window(spark, seed):
    rng = random.Random(100 + seed)
    rows = sorted({(k, t) for k in "ab" for t in (rng.randrange(3000) for _ in range(rng.choice([60, 400])))})
    _dedup_case(spark, [(k, t, i) for i, (k, t) in enumerate(rows)], 60, rng.choice([10, 25, 59, 61]), span=rng.choice([2, 4, 64]))


def test_dedup_one_hot_key_without_gaps(spark):
    # one key holds nearly all rows and never pauses, so no chunk can be settled by itself
    rows = [("hot", t, t) for t in range(0, 20_000, 3)] + [("cold", t, 100_000 + t) for t in range(0, 20_000, 7000)]
    _dedup_case(spark, rows, 61, 1000)


def test_dedup_exact_boundary_and_ties(spark):
    rows = [("k", 0, 2), ("k", 0, 1), ("k", 59, 3), ("k", 60, 4), ("k", 60, 5), ("k", 119, 6), ("k", 120, 7), ("k", 1000, 8), ("k", 1059, 9)]
    _dedup_case(spark, rows, 60, 60)
    _dedup_case(spark, rows, 60, 90)


def test_epoch_and_page_context(spark):
    rows = [(1, 5, 1, "http", "https://x/a"), (1, 10, 2, "nav", "https://one.com/"), (1, 12, 3, "http", "u"), (1, 30, 4, "nav", "https://two.com/"),
            (1, 30, 5, "http", "u"), (2, 1, 6, "http", "u")]
    df = spark.createDataFrame(rows, "tab_id bigint, ts_ms bigint, request_id bigint, kind string, url string")
    got = {r.request_id: r.epoch for r in dedup.navigation_epoch(df, width=8).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 0}
    hosts = {r.request_id: r.page_host for r in dedup.page_context_asof(df, width=8).collect()}
    assert hosts == {1: None, 2: "one.com", 3: "one.com", 4: "two.com", 5: "two.com", 6: None}


def fragments(spark, times, track=1):
    rows = [(1, t[1] if isinstance(t, tuple) else track, i, t[0] if isinstance(t, tuple) else t) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "file_id bigint, track_id int, seq bigint, decode_time bigint")


def test_validate_timeline(spark):
    check = lambda times, n=None: timeline.validate_timeline(
        fragments(spark, times), spark.createDataFrame([(1, n)], "file_id bigint, expected bigint") if n else None).first()
    assert check([(0, 1), (0, 2), (9000, 1), (2048, 2), (18000, 1), (4096, 2)], 6).ok
    bad = check([0, 9000, 4500], 3)
    assert (bad.ok, bad.reason, bad.first_bad_seq) == (False, "tfdt_regression_track1", 2)
    assert check([(0, 1), (9000, 1), (18000, 1), (0, 2), (2048, 2)], 5).ok
    assert check([0, 9000], 10).reason == "fragment_count_2_of_10"
    assert check([0, None, 5]).ok


def test_repair_timeline(spark):
    fixed = timeline.repair_timeline(fragments(spark, [0, 9000, 18000, 0, 9000])).orderBy("seq").collect()
    assert [r.fixed_time for r in fixed] == [0, 9000, 18000, 18000, 18000]
    assert sum(r.repaired for r in fixed) == 2
    assert not any(r.repaired for r in timeline.repair_timeline(fragments(spark, [0, 9000, 18000])).collect())


def test_repair_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(timeline, "SEQ_WIDTH", 5)
    rng = random.Random(1)
    times = [rng.randrange(1000) for _ in range(400)]
    fixed = timeline.repair_timeline(fragments(spark, times)).orderBy("seq").collect()
    top = -1
    for r, t in zip(fixed, times):
        assert r.repaired == (t < top)
        top = max(top, t)
        assert r.fixed_time == top


def test_sample_tables(spark):
    rows = [(1, 1, 0, 100, 1000, 3000, 0, True), (1, 1, 1, 1200, 2000, 3000, 0, False), (1, 1, 2, 6000, 1500, 3000, 0, False)]
    s = spark.createDataFrame(rows, "file_id bigint, track_id int, seq bigint, src_offset bigint, sample_size bigint, sample_duration bigint, cts_offset int, is_sync boolean")
    runs = timeline.run_length(s, "sample_duration").collect()
    assert [(r.run_value, r.run_length) for r in runs] == [(3000, 3)]
    placed = timeline.assign_offsets(s)
    assert [r.new_offset for r in placed.orderBy("seq").collect()] == [0, 1000, 3000]
    chunks = timeline.contiguous_chunks(placed).collect()
    assert [(c.chunk_offset, c.sample_count, c.chunk_bytes) for c in chunks] == [(0, 3, 4500)]
    assert [r.sample_no for r in timeline.sync_index(s).collect()] == [1]
    totals = timeline.duration_totals(s).first()
    assert (totals.total_duration, totals.total_bytes) == (9000, 4500)


def test_interleaved_tracks_split_chunks(spark):
    rows = [(1, 1 + i % 2, i, i * 10, 10, 1, 0, True) for i in range(6)]
    s = spark.createDataFrame(rows, "file_id bigint, track_id int, seq bigint, src_offset bigint, sample_size bigint, sample_duration bigint, cts_offset int, is_sync boolean")
    chunks = timeline.contiguous_chunks(timeline.assign_offsets(s)).orderBy("track_id", "chunk_no").collect()
    assert [c.chunk_offset for c in chunks] == [0, 20, 40, 10, 30, 50]
    assert timeline.sync_index(s).count() == 0


def test_run_length_across_buckets(spark):
    values = [1, 1, 2, 2, 2, None, None, 1, 1, 1, 1, 3]
    df = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(values)], "file_id bigint, track_id int, seq bigint, v bigint")
    runs = timeline.run_length(df, "v", width=3).orderBy("run_no").collect()
    assert [(r.first_pos, r.run_value, r.run_length) for r in runs] == [(0, 1, 2), (2, 2, 3), (5, None, 2), (7, 1, 4), (11, 3, 1)]


def test_await_audio(spark):
    rows = [(1, "g", 1, 0, 100022, "video"), (1, "g", 2, 12_000, 30216, "audio"), (1, "g", 3, 12_001, 100026, "video"), (1, "g", 4, 24_002, 30280, "audio"),
            (1, "h", 5, 0, 7, "video"), (1, "g", 6, 24_002, 9, "video")]
    df = spark.createDataFrame(rows, "tab_id bigint, group_id string, request_id bigint, ts_ms bigint, codec_id bigint, track_type string")
    got = {r.request_id: (r.audio_codec, r.silent) for r in items.await_audio(df, keys=["tab_id", "group_id"], width=1000).collect()}
    assert got == {1: (30216, False), 3: (None, True), 5: (None, True), 6: (30280, False)}


def test_numbered_splits_a_hot_group(spark):
    df = spark.createDataFrame([("one name", i) for i in range(5000)], "path string, ts bigint")
    got = numbered(df, keys=["path"], order=["ts"], bucket=every("ts", 100))
    assert got.filter("rank <> ts + 1").count() == 0
    # no window runs over the whole group: every shuffle of wide rows includes the bucket
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(got))
    assert any("_bucket" in x for x in shuffles)
    assert all("_bucket" in x or "_t_rank" not in x for x in shuffles)


def test_running_values_of_null_keys_and_orders_equal_a_plain_window(spark):
    rows = [(k, None if i % 11 == 0 else i * 400_000, i, i) for i in range(300) for k in (None, "a")]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint")
    got = running(df, keys=["k"], order=["t", "id"], bucket=every("t", 3_600_000), s=Running("sum", F.col("v")))
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_dedup_keeps_null_keys_and_rows_without_time(spark):
    rows = [(None, "u", 0, 1), (None, "u", 30_000, 2), (None, "u", 60_000, 3), (1, None, 5, 4), (1, None, 6, 5), (1, "u", None, 6), (1, "u", None, 7)]
    df = spark.createDataFrame(rows, "tab bigint, url string, ts_ms bigint, request_id bigint")
    got = dedup.dedup_window(df, keys=["tab", "url"])
    assert sorted(r.request_id for r in got.collect()) == [1, 3, 4, 6, 7]


SAMPLES = "file_id bigint, track_id int, seq bigint, src_offset bigint, sample_size bigint"


def _samples(spark):
    rng = random.Random(8)
    sizes = {None: 40, 5: 60, **{f: rng.randint(1, 8) for f in (0, 1, 2, 3, 4, 6, 7)}}
    rows = [(f, None if f == 3 else i % 2, i, (i if f == 1 else 9 * i % 97) * 100, rng.randint(0, 2)) for f, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, SAMPLES).repartition(5)


def _run_lengths(samples, busy):
    chunks = timeline.contiguous_chunks(timeline.assign_offsets(samples, busy=busy), busy=busy)
    return timeline.run_length(chunks, "sample_count", order="chunk_no", busy=busy)


def test_layout_chunks_and_runs_of_small_files_share_one_shuffle(spark):
    samples = _samples(spark)
    plan = plan_of(_run_lengths(samples, timeline.busy_files(samples)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("most, files", [(0, {None, *range(8)}), (8, {None, 5}), (50, {5})])
def test_busy_and_small_groups_give_the_same(spark, monkeypatch, most, files):
    samples = _samples(spark)
    monkeypatch.setattr(scan, "PLAIN_ROWS", most)
    busy = timeline.busy_files(samples)
    assert {r[0].file_id for r in busy.found.collect()} == files
    whole = scan.Busy(["file_id"], None)
    for got, want in (
            (_run_lengths(samples, busy), _run_lengths(samples, whole)),
            (timeline.run_length(samples, "sample_size"), timeline.run_length(samples, "sample_size", busy=whole)),
            (timeline.assign_offsets(samples), timeline.assign_offsets(samples, busy=whole))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    # a file's samples in source order, one after the other
    at = {}
    for r in sorted(timeline.assign_offsets(samples).collect(), key=lambda r: (str(r.file_id), r.src_offset)):
        assert r.new_offset == at.get(r.file_id, 0)
        at[r.file_id] = r.new_offset + r.sample_size
