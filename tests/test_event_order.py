"""Rules that go by event order: attribution as the log has it, and streams whose files arrive out of order."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediatally.functions import media
from mediatally.operators import dedup, items
from mediatally.streaming import ordered, requests as streams, run, tasks

LOG = "request_id bigint, tab_id bigint, ts_ms bigint, kind string, url string, mime string"


def folder_of(url):
    return url.rsplit("/", 1)[0] + "/"


def near(a, b):
    return a.startswith(b) or b.startswith(a)


def in_turn(segments, manifests):
    """The log's rule, one event at a time: counts per (tab, folder, manifest), and the manifests known by name only."""
    events = [(ts, 0, key, tab, None) for tab, key, ts in manifests] + [(ts, 1, n, tab, (url, named)) for n, tab, ts, url, named in segments]
    known, waiting = defaultdict(dict), defaultdict(Counter)
    counts, said = Counter(), {}

    def add(tab, key):
        known[tab][key] = folder_of(key)
        for d in [d for d in waiting[tab] if near(d, folder_of(key))]:
            counts[tab, d, key] += waiting[tab].pop(d)

    for ts, _, n, tab, segment in sorted(events, key=lambda e: e[:3]):
        if segment is None:
            if n not in known[tab]:
                add(tab, n)
            continue
        d = folder_of(segment[0])
        owner = next((k for k, at in known[tab].items() if near(d, at)), segment[1])
        if owner is None:
            waiting[tab][d] += 1
        else:
            if owner not in known[tab]:
                said[tab, owner] = ts
                add(tab, owner)
            counts[tab, d, owner] += 1
    for tab, held in waiting.items():
        for d, n in held.items():
            counts[tab, d, None] += n
    return counts, said


@pytest.mark.parametrize("seed", range(6))
def test_each_segment_counts_once_as_the_log_has_it(spark, seed):
    rng = random.Random(seed)
    folders = ["https://a.example/", "https://a.example/x/", "https://a.example/x/y/", "https://a.example/z/", "https://b.example/x/", "https://b.example/x/q/"]
    segments, manifests = [], {}
    for n in range(250):
        tab, folder, ts = rng.randint(1, 3), rng.choice(folders), rng.randrange(10_000)
        if rng.random() < 0.04:
            key = (tab, folder + rng.choice(["m.m3u8", "n.mpd"]))
            manifests[key] = min(ts, manifests.get(key, ts))
        else:
            named = rng.choice([None, None, rng.choice(folders) + rng.choice(["m.m3u8", "o.m3u8"])])
            segments.append((n, tab, ts, f"{folder}s{n % 9}.ts", named))
    found = [(tab, key, ts) for (tab, key), ts in manifests.items()]
    s = spark.createDataFrame(segments, "request_id bigint, tab_id bigint, ts_ms bigint, url string, parent_manifest string")
    m = spark.createDataFrame(found, "tab_id bigint, dedup_key string, detected_ms bigint")
    got = items.attribute_in_order(s, m, session=["tab_id"])
    counts, said = in_turn(segments, found)
    assert {(r.tab_id, r.dir, r.dedup_key): r.segment_count for r in got.segments.collect()} == dict(counts)
    assert {(r.tab_id, r.dedup_key): r.detected_ms for r in got.named.collect()} == said
    assert got.segments.agg(F.sum("segment_count")).first()[0] == len(segments)


def test_attribution_of_empty_sides(spark):
    s = spark.createDataFrame([], "request_id bigint, tab_id bigint, ts_ms bigint, url string, parent_manifest string")
    m = spark.createDataFrame([(1, "https://a.example/m.mpd", 5)], "tab_id bigint, dedup_key string, detected_ms bigint")
    assert items.attribute_in_order(s, m, session=["tab_id"]).segments.collect() == []
    one = spark.createDataFrame([(1, 1, None, "https://a.example/s.ts", None)], s.schema)
    assert [tuple(r) for r in items.attribute_in_order(one, m.limit(0), session=["tab_id"]).segments.collect()] == [(1, "https://a.example/", None, 1)]


@pytest.fixture
def out_of_order(spark, tmp_path):
    """Rows written to several files in an order that is up to `late_ms` off, read back one file per trigger."""

    def make(rows, schema, files=5, late_ms=20_000, seed=0):
        rng = random.Random(seed)
        rows = sorted(rows, key=lambda r: r[2] + rng.randrange(late_ms))
        folder, size = str(tmp_path / "in"), -(-len(rows) // files)
        for i in range(0, len(rows), size):
            part = rows[i: i + size]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


END = {"request_id": -1, "tab_id": -1, "kind": "nav"}


def log_rows(n=400, seed=1, tabs=3):
    rng = random.Random(seed)
    urls = ["https://a.example/v/s1.ts", "https://a.example/v/w/s2.ts", "https://a.example/v/m.m3u8", "https://a.example/m.mpd", "https://b.example/k.m4s",
            "https://b.example/c.mp4?token=1", "https://b.example/c.mp4?token=2", "https://h.example/up/1/7_a-1-100022.m4s", "https://h.example/up/1/7_a-1-100026.m4s",
            "https://h.example/up/1/7_a-1-30216.m4s", "https://h.example/up/2/8_a-1-100020.m4s"]
    rows = []
    for i, ts in enumerate(sorted(rng.sample(range(300_000), n))):
        nav = rng.random() < 0.02
        rows.append((i, rng.randint(1, tabs), ts, "nav" if nav else "http", "https://h.example/" if nav else rng.choice(urls), None))
    return rows


def test_dedup_stream_out_of_order(spark, out_of_order):
    rows = log_rows()
    table = spark.createDataFrame(rows, LOG)
    want = {r.request_id for r in dedup.dedup_requests(table).collect()}
    stream, close = run.closable(out_of_order(rows, LOG).drop("kind", "mime"), **END)
    got = [r.request_id for r in run.drain(streams.stream_dedup_60s(stream, watermark="25 seconds", buckets=8), "t", close=close).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_navigation_stream_out_of_order(spark, out_of_order):
    rows = log_rows(seed=2)
    epochs = dedup.navigation_epoch(spark.createDataFrame(rows, LOG)).filter("kind = 'http'")
    merged = epochs.groupBy("tab_id", "epoch", items.urls.normalize_url(F.col("url")).alias("k")).agg(F.min("ts_ms"))
    stream, close = run.closable(out_of_order(rows, LOG), **END)
    got = run.drain(streams.stream_navigation_reset(stream, watermark="25 seconds", buckets=8, shards=3), "t", close=close)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, merged.collect()))


def brute_tracks(rows, quiet=1200):
    out, state = [], defaultdict(dict)

    def ready(tab, now):
        for g, s in state[tab].items():
            if s[2] is not None and s[2] <= now:
                if s[0] is not None:
                    out.append((tab, g, s[0], s[1], s[2]))
                s[2] = None

    for _, tab, ts, kind, url, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        ready(tab, ts)
        if kind == "nav":
            state[tab].clear()
        elif "/up/" in url:
            number, name = url.split("/")[-2:]
            group, codec = f"{number}/{name.rsplit('-', 2)[0]}", int(name.rsplit("-", 1)[1].split(".")[0])
            s = state[tab].setdefault(group, [None, None, None])
            side = 1 if 30000 <= codec < 100000 else 0
            if s[side] is None or codec > s[side]:
                s[side], s[2] = codec, ts + quiet
    for tab in list(state):
        ready(tab, 10**12)
    return sorted(out, key=str)


def test_track_stream_out_of_order(spark, out_of_order):
    rows = log_rows(600, seed=3)
    stream, close = run.closable(out_of_order(rows, LOG), **END)
    got = run.drain(streams.stream_track_groups(stream, watermark="25 seconds", buckets=8, shards=2), "t", close=close)
    assert sorted(map(tuple, got.collect()), key=str) == brute_tracks(rows)


def test_first_manifests_out_of_order(spark, out_of_order):
    rows = log_rows(500, seed=4) + [(900 + t, t, 400_000, "nav", "https://h.example/", None) for t in (1, 2, 3)]
    epochs = dedup.navigation_epoch(spark.createDataFrame(rows, LOG)).filter("kind = 'http'")
    kind = media.classify_hint(F.col("url"), F.col("mime"))
    session = ["tab_id", "epoch"]
    hints = items.keyed_hints(epochs).filter(kind == "manifest").groupBy(*session, "dedup_key").agg(F.min("ts_ms").alias("detected_ms"))
    want = items.attribute_segments(epochs.filter(kind == "segment"), hints, session=session)
    stream, close = run.closable(out_of_order(rows, LOG, files=6), **END)
    got = run.drain(streams.stream_first_manifests(stream, watermark="25 seconds", buckets=8, shards=3), "t", close=close)
    got = got.groupBy(*session, "dir", "dedup_key").agg(F.sum("segment_count").alias("n"))
    order = [*session, "dir", "dedup_key"]
    assert sorted(map(tuple, got.select(*order, "n").collect()), key=str) == sorted(map(tuple, want.select(*order, "segment_count").collect()), key=str)
    assert want.filter("dedup_key IS NULL").count() and want.filter("dedup_key IS NOT NULL").count()


def test_a_save_within_twelve_hours_prolongs_the_state(spark, out_of_order):
    hour, t = 3_600_000, 1_700_000_000_000
    rows = [(tab, tab, t + at) for tab, at in (
        (1, 0), (1, 11 * hour), (1, 23 * hour), (1, 36 * hour), (2, 5), (3, 0), (3, 13 * hour), (3, 13 * hour))]
    saves = out_of_order(rows, "n bigint, tab_id bigint, ts_ms bigint", files=4, late_ms=hour).select("tab_id", F.col("ts_ms").alias("saved_ms"))
    stream, close = run.closable(saves, tab_id=-1, saved_ms=run.LAST_MS)
    got = run.drain(streams.stream_live_states(stream, watermark="2 hours", buckets=4), "t", close=close)
    assert sorted((r[0], r[1] - t, r[2] - t, r[3], r[4] - t) for r in got.collect()) == [
        (1, 0, 23 * hour, 3, 35 * hour), (1, 36 * hour, 36 * hour, 1, 48 * hour), (2, 5, 5, 1, 12 * hour + 5),
        (3, 0, 0, 1, 12 * hour), (3, 13 * hour, 13 * hour, 2, 25 * hour)]


def test_what_waits_is_bounded_by_the_watermark(spark, out_of_order):
    """Nothing younger than the watermark leaves, and everything older has left."""
    rows = log_rows(300, seed=5)
    stream = out_of_order(rows, LOG, files=3).drop("kind", "mime")
    got = run.drain(streams.stream_dedup_60s(stream, watermark="25 seconds", buckets=4), "t").collect()
    latest = max(r[2] for r in rows)
    want = {r.request_id for r in dedup.dedup_requests(spark.createDataFrame(rows, LOG)).collect() if r.ts_ms < latest - 25_000}
    assert {r.request_id for r in got} == want


def test_a_busy_tab_is_spread_over_buckets(spark):
    rows = [(i, 1, i, "nav" if i % 100 == 0 else "http", f"https://a.example/{i}.mp4", None) for i in range(4000)]
    df = spark.createDataFrame(rows, LOG)
    dealt = ordered.in_buckets(df, [F.col("tab_id")], buckets=64, shards=16, part=F.col("url"), everywhere=F.col("kind") == "nav")
    sizes = [r["count"] for r in dealt.filter("kind = 'http'").groupBy("bucket").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 4000 / 3
    assert dealt.filter("kind = 'nav'").count() == 40 * 16


def test_first_audio_out_of_order(spark, out_of_order):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 2), 10_000 + rng.randrange(200_000), rng.choice("gh"), rng.choice(["video", "audio"]), rng.randint(1, 9)) for i in range(120)]
    schema = "request_id bigint, tab_id bigint, ts_ms bigint, group_id string, track_type string, codec_id bigint"
    want = items.await_audio(spark.createDataFrame(rows, schema), keys=["tab_id", "group_id"], width=30_000)
    stream, close = run.closable(out_of_order(rows, schema), tab_id=-1, request_id=-1, group_id="", track_type="audio", codec_id=0)
    got = run.drain(streams.stream_first_audio(stream, watermark="25 seconds", buckets=4), "t", close=close)
    columns = ["tab_id", "group_id", "request_id", "codec_id", "audio_ts_ms", "silent"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_rows_reach_a_key_in_slices(spark):
    """Not one by one in Python, as `transformWithStateInPandas` hands them over."""
    stream = spark.readStream.format("rate").load().selectExpr("value AS task_id", "value AS ts_ms", "value AS seq", "value AS bytes")
    plan = tasks.stream_progress(stream)._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


class _Held:
    """A key's state between calls, as Spark keeps it."""

    def __init__(self):
        self.get, self.exists, self.mark, self.timeout = None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, ms):
        assert ms >= max(self.mark, 1)
        self.timeout = ms


def test_a_key_releases_what_the_watermark_has_reached(spark):
    class Every(ordered.InOrder):
        def decide(self, rows, upto, memory):
            return list(rows.itertuples(index=False, name=None)), {}

    rule, state = Every(["ts", "n"], ["ts", "n"], ["ts", "n"]), _Held()
    calls = [(0, [(5, 1), (30, 2)], []), (0, [(20, 3)], []), (20, [], [(5, 1), (20, 3)]), (25, [(22, 4), (40, 5)], [(22, 4)]), (99, [], [(30, 2), (40, 5)])]
    due = [4, 4, 29, 29, None]
    for (mark, rows, want), at in zip(calls, due):
        state.mark, state.timeout = mark, None
        frames = [pd.DataFrame(rows[i: i + 1], columns=["ts", "n"]) for i in range(len(rows))]
        got = [tuple(r) for pdf in rule.advance((0,), iter(frames), state) for r in pdf.itertuples(index=False)]
        assert got == want and state.timeout == at
    assert not state.exists
