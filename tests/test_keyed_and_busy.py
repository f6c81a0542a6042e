"""The keyed sink, progress streams, late rows, and buckets that are cut again."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediatally.operators import dedup, fetch, items, scan
from mediatally.session import scratch_dir
from mediatally.streaming import requests as streams, run, tasks
from mediatally.streaming.keyed import KeyedTable

ITEM = "tab_id bigint, dedup_key string, detected_ms bigint, size bigint, ts_ms bigint"


def keyed(spark, **more):
    return KeyedTable(spark, scratch_dir(spark, "keyed"), ITEM, keys=["tab_id", "dedup_key"], order=["ts_ms"], first="detected_ms", **{"buckets": 8, **more})


def updates(seed, n=40):
    rng = random.Random(seed)
    return [(rng.randint(1, 3), f"k{rng.randint(1, 9)}", ts, rng.randint(1, 99), ts) for ts in rng.sample(range(10_000), n)]


def expected(spark, rows):
    df = spark.createDataFrame(rows, ITEM)
    out = items.upsert_items(df, keys=["tab_id", "dedup_key"], order=["ts_ms"], first="detected_ms")
    return sorted(map(tuple, out.select("tab_id", "dedup_key", "detected_ms", "size", "ts_ms").collect()))


def test_batches_and_their_reruns_leave_one_row_per_key(spark):
    kept, batches = keyed(spark), [updates(s) for s in range(4)]
    assert kept.current().collect() == [] and kept.versions() == []
    for i, rows in enumerate(batches):
        kept.upsert(spark.createDataFrame(rows, ITEM), i)
        kept.upsert(spark.createDataFrame(rows, ITEM), i)
    assert sorted(map(tuple, kept.current().collect())) == expected(spark, sum(batches, []))
    # the batch before the last one run again finds the state it found then
    kept.upsert(spark.createDataFrame(batches[2], ITEM), 2)
    kept.upsert(spark.createDataFrame(batches[3], ITEM), 3)
    assert sorted(map(tuple, kept.current().collect())) == expected(spark, sum(batches, []))
    assert sorted(map(tuple, kept.current(before=2).collect())) == expected(spark, batches[0] + batches[1])


def test_a_batch_that_was_cut_off_does_not_count(spark):
    kept = keyed(spark)
    kept.upsert(spark.createDataFrame(updates(1), ITEM), 0)
    spark.createDataFrame(updates(2), ITEM).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{kept.folder}/batch=1")
    fs, _ = kept._fs()
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{kept.folder}/batch=1/_SUCCESS"), False)
    assert kept.versions() == [0]
    assert sorted(map(tuple, kept.current().collect())) == expected(spark, updates(1))


def test_only_touched_buckets_are_written_and_old_versions_go(spark):
    kept = keyed(spark)
    kept.upsert(spark.createDataFrame(updates(1, 200), ITEM), 0)
    one = [(1, "k1", 20_000, 5, 20_000)]
    for i in (1, 2, 3):
        kept.upsert(spark.createDataFrame(one, ITEM), i)
    count = lambda v: len([p for p in kept._fs()[0].listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{kept.folder}/batch={v}")) if "bucket=" in p.getPath().getName()])
    first = count(0)
    assert first > 5 and count(1) == count(3) == 1
    want = sorted(map(tuple, kept.current().collect()))
    kept.tidy(keep=1)
    assert count(0) == first - 1 and count(1) == 0 and count(2) == count(3) == 1
    assert sorted(map(tuple, kept.current().collect())) == want == expected(spark, updates(1, 200) + one)


@pytest.fixture
def files(spark, tmp_path):
    def make(parts, schema):
        folder = str(tmp_path / "in")
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def test_sink_of_a_stream(spark, files):
    parts = [updates(s) for s in range(3)]
    kept = keyed(spark)
    run.feed(files(parts, ITEM), "t", kept.upsert)
    assert len(kept.versions()) == 3
    assert sorted(map(tuple, kept.current().collect())) == expected(spark, sum(parts, []))


CHUNK = "task_id bigint, ts_ms bigint, seq bigint, bytes bigint"
T0 = 1_700_000_000_000


def chunks(n=400):
    rng = random.Random(7)
    return [(rng.randint(1, 3), T0 + i * 37 + rng.randrange(20), i, rng.choice([None, 1, 900_000, 3_000_000, 20_000_000])) for i in range(n)]


def in_parts(rows, n=4):
    rng = random.Random(1)
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(1500))
    size = -(-len(late) // n)
    return [late[i: i + size] for i in range(0, len(late), size)]


def test_progress_stream_equals_the_batch_form(spark, files):
    rows = chunks()
    stream, close = run.closable(files(in_parts(rows), CHUNK), task_id=-1, seq=0, bytes=0)
    got = run.drain(tasks.stream_progress(stream, watermark="2 seconds", pause_ms=0, buckets=4), "t", close=close)
    table = spark.createDataFrame(rows, CHUNK).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    want = fetch.progress_samples(table, keys=["task_id"], order=["ts_ms", "seq"], width=1000).select("task_id", "ts_ms", "seq", "total_bytes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_progress_rows_keep_their_distance(spark, files):
    rows = chunks()
    stream, close = run.closable(files(in_parts(rows), CHUNK), task_id=-1, seq=0, bytes=0)
    got = run.drain(tasks.stream_progress(stream, watermark="2 seconds", buckets=4), "t", close=close).collect()
    want, shown, total = [], {}, defaultdict(int)
    for task, ts, seq, n in sorted(rows, key=lambda r: (r[1], r[2])):
        before, total[task] = total[task], total[task] + (n or 0)
        if total[task] // tasks.STEP_BYTES > before // tasks.STEP_BYTES and ts - shown.get(task, 0) >= 400:
            shown[task] = ts
            want.append((task, ts, seq, total[task]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < 400


def test_late_rows_are_counted(spark, files):
    row = lambda i, ts: (i, 1, T0 + ts, f"https://film.test/{i}.mp4")
    parts = [[row(1, 100_000)], [row(2, 101_000)], [row(3, 5), row(4, 6), row(5, 102_000)]]
    stream = files(parts, "request_id bigint, tab_id bigint, ts_ms bigint, url string")
    counted = run.drain_counted(streams.stream_dedup_60s(stream, watermark="10 seconds", buckets=2), "t")
    late = {r.batch_id: r.rows_late for r in counted.progress.collect()}
    assert sum(late.values()) == 2 and late[2] == 2
    assert not {3, 4} & {r.request_id for r in counted.rows.collect()}


def test_a_busy_minute_is_cut_and_nothing_changes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, 1 if i % 3 == 0 else rng.randint(2, 60), (rng.randrange(60_000) if i % 3 == 0 else rng.randrange(40_000_000)),
             "nav" if rng.random() < 0.05 else "http", f"https://h{i % 7}.test/") for i in range(6000)]
    df = spark.createDataFrame(rows, "request_id bigint, tab_id bigint, ts_ms bigint, kind string, url string")
    want = sorted(map(tuple, dedup.navigation_epoch(df).collect()))
    hosts = sorted(map(str, dedup.page_context_asof(df).collect()))
    capped = sorted(map(str, items.cap_list(df, 50, session=["tab_id"], order=["ts_ms", "request_id"], width=scan.HOUR_MS).collect()))
    monkeypatch.setattr(scan, "MOST_ROWS", 500)
    monkeypatch.setattr(scan, "PARTS", 16)
    cut, bucket = scan.Spans("ts_ms", scan.HOUR_MS).cut(df, ["tab_id"])
    sizes = [r["count"] for r in cut.filter("tab_id = 1").groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2 * 2000 / 16
    assert sorted(map(tuple, dedup.navigation_epoch(df).collect())) == want
    assert sorted(map(str, dedup.page_context_asof(df).collect())) == hosts
    assert sorted(map(str, items.cap_list(df, 50, session=["tab_id"], order=["ts_ms", "request_id"], width=scan.HOUR_MS).collect())) == capped
