"""Merging, attribution, tracks, sessions and lists against hand-written and sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from mediatally.functions import urls
from mediatally.operators import admission, items, logs

from conftest import plan_of

HINT = "request_id bigint, tab_id bigint, ts_ms bigint, url string, mime string, size bigint"
SESSION = ["tab_id"]


def hints(spark, *rows):
    full = [(i, 1, i, r, None, None) if isinstance(r, str) else (i, 1, i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, HINT)


def test_merge_progressive(spark):
    got = items.merge_items(hints(spark, "https://cdn.example.com/video.mp4", ("https://cdn.example.com/video.mp4?token=2", None, 70), "blob:https://x.com/abc",
                                  ("https://cdn.example.com/song", "audio/mp4", 0)), session=SESSION)
    rows = {r.dedup_key: r for r in got.collect()}
    video = rows["https://cdn.example.com/video.mp4"]
    assert (video.protocol, video.media_type, video.downloadable, video.hint_count, video.size_estimate, video.detected_ms) == ("progressive", "video", True, 2, 70, 0)
    blob = rows["blob:https://x.com/abc"]
    assert (blob.downloadable, blob.blocked_reason) == (False, "blob")
    assert rows["https://cdn.example.com/song"].media_type == "audio"
    assert rows["https://cdn.example.com/song"].size_estimate is None
    assert len(rows) == 3


def test_merge_manifest(spark):
    got = items.merge_items(hints(spark, "https://c.com/vod/master.m3u8", ("https://c.com/live", "application/dash+xml", None), "https://c.com/vod/seg-1.ts"), session=SESSION)
    rows = {r.dedup_key: (r.protocol, r.status, r.title) for r in got.collect()}
    assert rows == {"https://c.com/vod/master.m3u8": ("hls", "parsing", "master"), "https://c.com/live": ("dash", "parsing", "live")}


def sequential(events):
    """Segments and manifests in order, one tab: the manifest each segment directory ends up with."""
    manifests, pending, owner = [], {}, {}
    related = lambda a, b: a.startswith(b) or b.startswith(a)
    for kind, url in events:
        d = url.rsplit("/", 1)[0] + "/"
        if kind == "m":
            if url not in [m[1] for m in manifests]:
                manifests.append((d, url))
                for p in [p for p in pending if related(p, d)]:
                    owner[url] = owner.get(url, 0) + pending.pop(p)
        else:
            hit = next((u for md, u in manifests if related(d, md)), None)
            if hit:
                owner[hit] = owner.get(hit, 0) + 1
            else:
                pending[d] = pending.get(d, 0) + 1
    return owner, pending


@pytest.mark.parametrize("seed", range(3))
def test_attribution_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    dirs = ["https://c.com/" + p for p in ("", "a/", "a/b/", "a/b/c/", "a2/", "d/e/", "d/e/f/")]
    events = []
    for i in range(150):
        d = rng.choice(dirs)
        events.append(("m", d + f"m{rng.randrange(2)}.m3u8") if rng.random() < 0.08 else ("s", d + f"s{i}.ts"))
    owner, pending = sequential(events)
    seg = spark.createDataFrame([(1, u) for k, u in events if k == "s"], "tab_id bigint, url string")
    first = {}
    for i, (k, u) in enumerate(events):
        if k == "m":
            first.setdefault(u, i)
    man = spark.createDataFrame([(1, u, t) for u, t in first.items()], "tab_id bigint, dedup_key string, detected_ms bigint")
    attributed = items.attribute_segments(seg, man, session=SESSION)
    got = {r.dedup_key: r.segment_count for r in items.segments_per_manifest(attributed, session=SESSION).collect()}
    assert got == owner
    assert {r.dir: r.segment_count for r in attributed.filter("dedup_key IS NULL").collect()} == pending


def test_attribution_plan_has_no_nested_loop(spark):
    seg = hints(spark, "https://c.com/a/s.ts")
    man = spark.createDataFrame([(1, "https://c.com/a/m.m3u8", 1)], "tab_id bigint, dedup_key string, detected_ms bigint")
    plan = plan_of(items.attribute_segments(seg, man, session=SESSION))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parent_manifest(spark):
    df = spark.createDataFrame([(1, 5, "https://c.com/dash/v1/seg-1.m4s", "https://c.com/dash/m.mpd"), (1, 6, "https://c.com/dash/a1/seg-1.m4s", "https://c.com/dash/m.mpd"),
                                (1, 7, "https://c.com/x.ts", None)], "tab_id bigint, ts_ms bigint, url string, parent_manifest string")
    r = items.attach_parent_manifest(df, session=SESSION).collect()
    assert [(x.dedup_key, x.segment_count, x.protocol, x.detected_ms) for x in r] == [("https://c.com/dash/m.mpd", 2, "dash", 5)]


def test_best_tracks(spark):
    base = "https://h/up/1/1/888/888_a-1-"
    df = hints(spark, base + "100022.m4s?s1", base + "100022.m4s?s2", base + "100026.m4s", base + "30216.m4s", "https://h/up/1/1/9/9_a-1-30216.m4s")
    tracks = items.best_tracks(df, by=SESSION)
    r = tracks.collect()
    assert [(x.group_id, x.video_codec, x.audio_codec) for x in r] == [("888/888_a", 100026, 30216)]
    item = items.track_items(tracks, session=SESSION).first()
    assert (item.dedup_key, item.dual, item.video_track, item.audio_track) == ("nolist:888/888_a", True, "v100026", "a30216")


def test_session_summary(spark):
    df = spark.createDataFrame([(1, "ready", True), (1, "parsing", True), (1, "protected", False)], "tab_id bigint, status string, downloadable boolean")
    rejected = spark.createDataFrame([(1,), (1,), (2,)], "tab_id bigint")
    got = {r.tab_id: tuple(r)[1:] for r in items.session_summary(df, by=SESSION, rejected=rejected).collect()}
    assert got == {1: (3, 1, 1, 1, 2), 2: (0, 0, 0, 0, 1)}


def test_domain_rules(spark):
    df = spark.createDataFrame([("a.example.com",), ("example.com",), ("badexample.com",), ("x.y.Example.com",), ("other.org",)], "host string")
    keep = lambda rules, mode="blacklist": sorted(r.host for r in admission.admit_domain(df, rules, mode).collect())
    assert keep(["example.com", " ", "*.org"]) == ["badexample.com", "other.org"]
    assert keep(["a.example.com"], "whitelist") == ["a.example.com"]
    assert keep([]) == keep([], "all") and keep([], "whitelist") == []
    table = spark.createDataFrame([("EXAMPLE.com",), ("*.org",), ("",), ("\tother.org\u3000",)], "domain string")
    assert keep(table) == ["badexample.com"] and keep(["\tother.org ", "example.com"]) == ["badexample.com"]
    long = ["example.com"] + [f"r{i}.net" for i in range(600)]
    assert keep(long) == ["badexample.com", "other.org"]
    assert "NestedLoop" not in plan_of(admission.admit_domain(df, table))


def test_filters(spark):
    cfg = admission.Admission(media_type="audio", min_size_mb=1, extensions=["mp3"])
    df = hints(spark, ("https://x/a.mp3", None, 2 << 20), ("https://x/a.mp3", None, 10), ("https://x/a.mp4", "video/mp4", None), ("https://x/a.m4a", None, None),
               ("https://x/a.m3u8", None, 1), ("https://x/a.ts", None, 1))
    assert [r.reject_reason for r in admission.apply_filters(df, cfg).orderBy("request_id").collect()] == [None, "min_size", "type", "extension", None, None]


def test_status_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.createDataFrame([(1, 1, 200, "GET", "u")], "request_id bigint, tab_id bigint, status_code int, method string, url string").write.parquet(path)
    plan = plan_of(admission.admit_http(spark.read.parquet(path)).select("request_id"))
    assert "PushedFilters: [IsNotNull(tab_id), IsNotNull(status_code), IsNotNull(method), GreaterThanOrEqual(tab_id,0)" in plan
    assert "url" not in plan.split("ReadSchema")[1]


def test_import_domains(spark):
    lines = spark.createDataFrame([("\tExample.COM ",), ("bad domain",), ("-x.com",), ("a.b-c.io",)], "value string")
    got = {r.domain: r.valid for r in admission.import_domains(lines).collect()}
    assert got == {"example.com": True, "bad domain": False, "-x.com": False, "a.b-c.io": True}


def test_upsert(spark):
    df = spark.createDataFrame([(1, "k", 10, 1, "a"), (1, "k", 20, 2, "b")], "tab_id bigint, dedup_key string, detected_ms bigint, version bigint, title string")
    r = items.upsert_items(df, keys=["tab_id", "dedup_key"], order=["version"], first="detected_ms").first()
    assert (r.detected_ms, r.title) == (10, "b")


def test_lists(spark):
    df = spark.createDataFrame([(1, "Song", 7530.0, 300 << 20, "1920x1080", 1), (2, "Film", None, None, None, 2), (3, "Clip", 60.0, 5 << 20, "640x360", 3)],
                               "media_id bigint, title string, duration_sec double, size_bytes bigint, resolution string, detected_ms bigint")
    ids = lambda d: [r.media_id for r in d.collect()]
    assert ids(items.search_items(df, "FILM")) == [2] and ids(items.search_items(df, "02:05")) == [1] and ids(items.search_items(df, "5.0 mb")) == [3]
    assert ids(items.smart_search(df, "300")) == [1] and ids(items.smart_search(df, "125:00")) == [1] and ids(items.smart_search(df, "lip")) == [3]
    assert ids(items.sort_items(df, "size", False, tie="media_id")) == [3, 1, 2]
    assert ids(items.sort_items(df, "resolution", True, tie="media_id")) == [1, 3, 2]


def test_log_filter_and_lines(spark):
    df = spark.createDataFrame([(1, 3_661_000, "INFO", "ui", "start", None), (2, 0, "ERROR", "engine", "boom", "https://c.com/a/b/c/d?token=1")],
                               "log_id bigint, ts_ms bigint, level string, module string, msg string, detail string")
    assert [r.log_id for r in logs.filter_logs(df, "WARN").collect()] == [2]
    assert logs.filter_logs(df, "ALL").count() == 2
    assert [r.log_id for r in logs.filter_logs(df, "DEBUG", "boomhttps").collect()] == [2]
    lines = [r.l for r in df.select(logs.log_line().alias("l")).collect()]
    assert lines == ["01:01:01 [INFO] ui: start", "00:00:00 [ERROR] engine: boom (c.com/a/b/c/***)"]


def test_track_requests_are_not_in_the_way(spark):
    df = hints(spark, "https://h/r/1/1_a-1-100022.m4s?x", "https://h/dash/v1/s1.m4s")
    assert [r.v for r in df.select(urls.is_track_url(F.col("url")).alias("v")).collect()] == [True, False]
