"""Readers, sinks, page scans, and streams fed in several batches."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediatally.plans.tables import table
from mediatally.session import scratch_dir, stage
from mediatally.sources import pages, requests as req, segments
from mediatally.streaming import requests as streams, run, tasks as task_streams

from test_ordered import greedy

T0 = 1_700_000_000_000  # rows at or before the first watermark, the epoch, count as late
HTML = [
    '<body><video src="/a.mp4" poster="p.jpg" title="x src=no"><source src="b.webm"></video><source src="out.mp4"></body>',
    '<!-- <video src="c.mp4"></video> --><script>"<video src=\'d.mp4\'>"</script><audio><source src=https://o.com/e.mp3?x=1&amp;y=2></audio>',
    '<VIDEO SRC="blob:https://x/1" ARIA-LABEL="it"></VIDEO><video src="blob:https://x/1"></video><video src="/page"></video>',
    "<p>no media</p>",
]


def test_scan_pages(spark):
    df = spark.createDataFrame([(i, "https://h.com/d/page", h) for i, h in enumerate(HTML)], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.tag, r.url, r.is_blob, r.poster_url, r.title) for r in pages.scan_pages(df).collect())
    assert got == [
        (0, "source", "https://h.com/d/b.webm", False, None, None),
        (0, "video", "https://h.com/a.mp4", False, "https://h.com/d/p.jpg", "x src=no"),
        (1, "source", "https://o.com/e.mp3?x=1&y=2", False, None, None),
        (2, "video", "blob:https://x/1", True, None, "it"),
    ]


class _Scan(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in ("video", "audio", "source") or (tag == "source" and not self.depth):
            return
        self.depth += tag != "source"
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.found.append({
            "rank": len(self.found) + (1_000_000_000 if tag == "source" else 0), "tag": tag, "src": first.get("src"),
            "poster": first.get("poster"), "title": first.get("title", first.get("aria-label"))})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("video", "audio"):
            self.depth = max(0, self.depth - 1)


def test_elements_agree_with_a_parser(spark, sf):
    odd = "<video src='/a.mp4?x=1&amp;#39;' title=\"A&#x27;B &#233; &#1114112; &lt;i&gt;\"><source src=b.webm></video><audio src=c.mp3 title='&#128512;&amp;#65;'>"
    rows = [r.html for r in table(spark, sf, "media_pages").collect()] + [odd.replace("&#1114112; ", "")]
    df = spark.createDataFrame([(h,) for h in rows], "html string")
    got = [[(e.tag, e.src, e.poster, e.title) for e in r.e] for r in df.select(pages._elements_by_pattern(F.col("html")).alias("e")).collect()]
    for html, found in zip(rows, got):
        scan = _Scan()
        scan.feed(html)
        scan.close()
        assert found == [(e["tag"], e["src"], e["poster"], e["title"]) for e in sorted(scan.found, key=lambda e: e["rank"])]


def test_headers(spark):
    df = spark.createDataFrame([(200, [("CONTENT-type", "video/mp4; x=1"), ("Content-Range", "bytes 0-1")]), (206, [("content-length", "abc")]), (200, [("Content-Length", "42")]), (200, None)],
                               "status_code int, response_headers array<struct<name:string,value:string>>")
    got = [(r.mime, r.size, r.has_range) for r in req.normalize_request(df).collect()]
    assert got == [("video/mp4", None, True), (None, None, True), (None, 42, False), (None, None, False)]


def test_read_requests_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"request_id":1,"tab_id":2,"url":"https://x/a.mp4","response_headers":[{"name":"Content-Type","value":"video/mp4"}]}\n')
    r = req.normalize_request(req.read_requests(spark, str(tmp_path), "json")).first()
    assert (r.request_id, r.mime) == (1, "video/mp4")


def test_segment_files(spark, tmp_path):
    for i in (2, 10):
        (tmp_path / f"t1#{i:08d}.bin").write_bytes(bytes([0x47, i]))
    rows = segments.scan_segments(spark, str(tmp_path)).orderBy("segment_index").collect()
    assert [(r.task_id, r.segment_index, r.length) for r in rows] == [("t1", 2, 2), ("t1", 10, 2)]


def test_decrypt(spark):
    df = spark.createDataFrame([(1, 7, b"hello"), (1, 8, b"x" * 40), (2, 1, b"clear"), (3, 1, b"odd")], "task_id bigint, segment_index bigint, content binary")
    key = F.lit(bytes(range(16)))
    iv = F.unhex(F.lpad(F.hex("segment_index"), 32, "0"))
    sealed = F.substring(F.aes_encrypt("content", key, F.lit("CBC"), F.lit("PKCS"), iv), 17, 1000)
    stored = df.withColumn("content", F.when(F.col("task_id") == 1, F.when(F.col("segment_index") == 8, F.concat(sealed, F.lit(b"zz"))).otherwise(sealed)).otherwise(F.col("content")))
    keys = spark.createDataFrame([(1, bytes(range(16)), None), (3, bytes(16), None)], "task_id bigint, key binary, iv_hex string")
    got = {(r.task_id, r.segment_index): (r.status, r.plain and bytes(r.plain)) for r in segments.decrypt_segments(stored, keys).collect()}
    assert got == {(1, 7): ("decrypted", b"hello"), (1, 8): ("decrypted", b"x" * 40), (2, 1): ("clear", b"clear"), (3, 1): ("decrypt_failed", None)}


def test_log_sink(spark, sf, tmp_path):
    out = str(tmp_path / "logs")
    segments.write_logs(table(spark, sf, "logs"), out)
    assert spark.read.text(out).filter("value RLIKE 'token='").count() == 0
    assert spark.read.text(out).count() == table(spark, sf, "logs").count()


def test_stage_and_scratch(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stage(spark.range(5), "five").count() == 5


@pytest.fixture
def in_batches(spark, tmp_path):
    """Write rows as one file per batch and read them back as a stream, one file per trigger."""

    def make(rows, schema, batches=4):
        folder = str(tmp_path / "in")
        size = -(-len(rows) // batches)
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def test_stream_dedup_in_batches(in_batches):
    rng = random.Random(3)
    rows = sorted((1, "https://c/" + rng.choice("ab") + "?x=" + str(i), T0 + rng.randrange(600_000), i) for i in range(300))
    rows = [(i, t, ts, u) for t, u, ts, i in sorted(rows, key=lambda r: (r[2], r[3]))]
    stream, close = run.closable(in_batches(rows, "request_id bigint, tab_id bigint, ts_ms bigint, url string"), request_id=-1, tab_id=-1)
    got = {r.request_id for r in run.drain(streams.stream_dedup_60s(stream, watermark="1 minute", buckets=8), "t", close=close).collect()}
    assert got == greedy([(u.split("?")[0], ts, i) for i, _, ts, u in rows], 60_000)


def test_stream_tracks(in_batches):
    u = "https://h/up/1/1/888/888_a-1-"
    rows = [(1, 1, 0, "http", u + "100022.m4s?1"), (2, 1, 100, "http", u + "100022.m4s?1"), (3, 1, 200, "http", u + "30216.m4s"), (4, 1, 5000, "http", u + "100026.m4s"),
            (5, 1, 5500, "nav", "https://h/"), (6, 1, 9000, "http", "https://h/up/2/2/7/7_b-1-30216.m4s"), (7, 1, 90_000, "nav", "https://h/")]
    stream = in_batches(rows, "request_id bigint, tab_id bigint, ts_ms bigint, kind string, url string", 7)
    got = [tuple(r) for r in run.drain(streams.stream_track_groups(stream, watermark="10 seconds"), "t").collect()]
    # the better video at 5000 is cleared by the page load before its quiet time is over; audio alone is never put out
    assert got == [(1, "888/888_a", 100022, 30216, 1400)]


def test_stream_navigation(in_batches):
    rows = [(1, 1, T0, "http", "https://h/a.mp4?token=1"), (2, 1, T0 + 10, "http", "https://h/a.mp4?token=2"), (3, 1, T0 + 20, "nav", "https://h/"),
            (4, 1, T0 + 30, "http", "https://h/a.mp4"), (5, 2, T0 + 40, "http", "https://h/a.mp4")]
    stream = in_batches(rows, "request_id bigint, tab_id bigint, ts_ms bigint, kind string, url string", 5)
    stream, close = run.closable(stream, request_id=-1, tab_id=-1, kind="nav")
    got = sorted(tuple(r) for r in run.drain(streams.stream_navigation_reset(stream, buckets=4, shards=2), "t", close=close).collect())
    assert got == [(1, 0, "https://h/a.mp4", T0), (1, 1, "https://h/a.mp4", T0 + 30), (2, 0, "https://h/a.mp4", T0 + 40)]


def test_stream_items_in_batches(in_batches):
    rows = [(i, 1, i, f"https://h/{i % 2}.mp4?token={i}", None if i < 2 else i) for i in range(8)]
    stream = in_batches(rows, "request_id bigint, tab_id bigint, ts_ms bigint, url string, size bigint")
    got = sorted(tuple(r) for r in streams.current_items(run.drain_updates(streams.stream_items(stream), "t")).select(
        "dedup_key", "detected_ms", "updated_ms", "hint_count", "size_estimate").collect())
    assert got == [("https://h/0.mp4", 0, 6, 4, 2), ("https://h/1.mp4", 1, 7, 4, 3)]


def test_late_rows_are_dropped(in_batches):
    # Spark tests for lateness with the watermark of the batch before, so the late row comes two batches on
    rows = [(1, 0), (1, 100_000), (1, 150_000), (1, 1), (1, 200_000)]
    stream = in_batches(rows, "tab_id bigint, ts_ms bigint", 5)
    got = sorted(tuple(r) for r in run.drain(streams.closed_window_counts(stream), "t").collect())
    assert got == [(1, 0, 1), (1, 100_000, 1), (1, 150_000, 1)]


def test_stream_await_audio(spark, tmp_path):
    def side(name, rows):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "tab_id bigint, group_id string, ts_ms bigint, codec_id bigint").coalesce(1).write.parquet(folder)
        return spark.readStream.schema("tab_id bigint, group_id string, ts_ms bigint, codec_id bigint").parquet(folder)

    t = 1_700_000_000_000
    video = side("v", [(1, "g", t, 9), (1, "h", t, 8), (1, "z", t + 500_000, 1)])
    audio = side("a", [(1, "g", t + 12_000, 30216), (1, "h", t + 12_001, 30280), (1, "z", t + 500_000, 2)])
    got = sorted(tuple(r) for r in run.drain(streams.stream_await_audio(video, audio), "t").select("group_id", "audio_codec", "silent").collect())
    assert ("g", 30216, False) in got and ("h", None, True) in got


def test_completions(spark):
    df = spark.createDataFrame([(t, n) for t, n in ((0, "a"), (1999, "b"), (2000, "c"), (4000, "d"), (4001, "e"), (4002, "f"))], "ts_ms bigint, title string")
    df = df.withColumn("event_time", F.timestamp_millis("ts_ms"))
    got = sorted(tuple(r) for r in task_streams.completion_notices(task_streams.completion_windows(df)).select("window_ms", "notice").collect())
    assert got == [(0, "a"), (0, "b"), (2000, "c"), (4000, "3 completed")]


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["tab_id", "epoch"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
