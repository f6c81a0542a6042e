"""HLS and DASH examples."""

import pytest
from pyspark.sql import functions as F

from mediatally.operators import analysis, dash, hls

MASTER = """#EXTM3U
#EXT-X-STREAM-INF:BANDWIDTH=777000,RESOLUTION=640x360
small/list.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=8100000,RESOLUTION=2560x1440,CODECS="hvc1.2.4.L150,ac-3"

# note between
large/list.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=3300000,RESOLUTION=1440x1080
middle/list.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=96500
voice.m3u8
"""
MEDIA = "#EXTM3U\r\n#EXT-X-TARGETDURATION:7\r\n#EXTINF:6.25,\r\np0.ts\r\n#EXTINF:6.5,words\r\n#EXT-X-BYTERANGE:31@64\r\n  p1.ts \r\np2.ts\r\n#EXTINF:1.125,\r\n#EXT-X-BYTERANGE:9\r\nhttps://else.test/p3.ts\r\n#EXT-X-ENDLIST\r\n"
AES = """#EXTM3U
#EXT-X-MEDIA-SEQUENCE:37
#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://y"
#EXT-X-KEY:METHOD=AES-128,URI="lock/k1",IV=0X00ff17a2
#EXTINF:3,
q.ts"""


def manifests(spark, *bodies, base="https://media.test/show/all.m3u8"):
    return spark.createDataFrame([(i, base, b) for i, b in enumerate(bodies)], "manifest_id bigint, url string, body string")


def test_master(spark):
    rows = hls.hls_variants(manifests(spark, MASTER)).orderBy("rank").collect()
    assert [r.quality_label for r in rows] == ["2K", "1080p", "360p", ""]
    assert rows[2].playlist_url == "https://media.test/show/small/list.m3u8"
    assert [r.variant_id for r in rows] == ["2560x1440-1", "1440x1080-2", "640x360-0", "96500-3"]
    assert rows[0].codecs == "hvc1.2.4.L150,ac-3" and rows[1].codecs is None


def test_media(spark):
    df = manifests(spark, MEDIA)
    rows = hls.hls_segments(df).orderBy("pos").collect()
    assert [(r.segment_url.rsplit("/", 1)[1], r.duration_sec, r.range_length, r.range_offset) for r in rows] == [
        ("p0.ts", 6.25, None, None), ("p1.ts", 6.5, 31, 64), ("p2.ts", 0.0, None, None), ("p3.ts", 1.125, 9, 0)]
    total = hls.playlist_totals(df).first()
    assert (total.segment_count, round(total.duration_sec, 6), total.live, total.target_sec, total.encryption) == (4, 13.875, False, 7.0, "none")
    starts = [r.start_sec for r in hls.cumulative_start(hls.hls_segments(df)).orderBy("pos").collect()]
    assert starts == pytest.approx([0, 6.25, 12.75, 12.75])


def test_aes(spark):
    df = manifests(spark, AES)
    enc = hls.hls_encryption(df).first()
    assert (enc.method, enc.key_url, enc.iv_hex) == ("aes128", "https://media.test/show/lock/k1", "00ff17a2")
    assert hls.hls_segments(df).first().segment_index == 37
    item = hls.hls_items(df).first()
    assert (item.status, item.downloadable, item.blocked_reason) == ("unsupported", False, "live")


def test_errors_are_rows(spark):
    df = manifests(spark, "nope", "#EXTM3U\n#EXT-X-ENDLIST", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1")
    assert {r.manifest_id: r.parse_error for r in hls.hls_segments(df).collect()} == {0: "missing #EXTM3U", 1: "no segments in media playlist"}
    assert {r.manifest_id: r.parse_error for r in hls.hls_variants(df).collect()} == {0: "missing #EXTM3U", 2: "no variants in master playlist"}
    assert {r.manifest_id: r.status for r in hls.hls_items(df).collect()} == dict.fromkeys(range(3), "parse_failed")


def test_long_playlist_with_many_tags(spark):
    body = "#EXTM3U\n" + "#X\n" * 20_000 + "".join(f"#EXTINF:1,\n{i}.ts\n" for i in range(3000)) + "#Y\n" * 20_000
    df = manifests(spark, body)
    total = hls.playlist_totals(df).first()
    assert (total.segment_count, total.duration_sec) == (3000, 3000.0)
    assert hls.hls_segments(df).count() == 3000


def test_attributes_last_wins(spark):
    df = spark.createDataFrame([('A=1,B="x,y",A=2,URI="",C=',)], "line string").select(hls.attributes(F.col("line")).alias("a"))
    assert df.first().a == {"B": "x,y", "A": "2", "URI": "", "C": ""}


def test_parsing_shuffles_nothing(spark):
    from conftest import plan_of
    for df in (hls.hls_variants(manifests(spark, MASTER)), hls.hls_segments(manifests(spark, MEDIA)), hls.playlist_totals(manifests(spark, MEDIA)),
               dash.dash_items(manifests(spark, "<MPD/>"))):
        assert "Exchange" not in plan_of(df)


MPD = """<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT2H0M9S"><Period>
<AdaptationSet mimeType="video/mp4"><ContentProtection schemeIdUri="urn:uuid:0a0b0c0d"/>
<Representation id="hi" bandwidth="5100000" width="2048" height="1152"/><Representation id="lo" bandwidth="910000" width="848" height="476"/></AdaptationSet>
<AdaptationSet contentType="audio" lang="fi"><Representation bandwidth="99000" codecs="opus" lang="sv"/></AdaptationSet></Period></MPD>"""
TEMPLATE = """<MPD mediaPresentationDuration="PT21S"><Period><AdaptationSet contentType="video">
<SegmentTemplate timescale="90" duration="540" startNumber="4" initialization="$RepresentationID$/head.mp4" media="$RepresentationID$/n$Number%02d$_$Number%04d$.m4s"/>
<Representation id="w" bandwidth="1" width="960" height="540"/></AdaptationSet></Period></MPD>"""
LIST = """<MPD type="dynamic"><Period><AdaptationSet contentType="video"><Representation id="v"><SegmentList duration="4">
<Initialization sourceURL="open.mp4"/><SegmentURL media="part-a.m4s"/><SegmentURL media="part-b.m4s"/></SegmentList></Representation></AdaptationSet></Period></MPD>"""
TIMELINE = """<MPD><Period><AdaptationSet contentType="audio"><SegmentTemplate timescale="1" media="$Time$-$Number$.m4s" duration="10">
<SegmentTimeline><S t="5" d="20"/><S d="10" r="2"/></SegmentTimeline></SegmentTemplate><Representation id="a"/></AdaptationSet></Period></MPD>"""
BASE = "https://media.test/dash/all.mpd"


def test_mpd(spark):
    reps = dash.mpd_representations(manifests(spark, MPD, base=BASE))
    rows = reps.orderBy("pos").collect()
    assert [(r.rep_id, r.track_type, r.resolution, r.lang) for r in rows] == [("hi", "video", "2048x1152", None), ("lo", "video", "848x476", None), ("rep-2", "audio", None, "fi")]
    assert rows[0].duration_sec == 7209 and not rows[0].live
    assert dash.drm_flag(reps).first().drm is True
    item = dash.dash_items(manifests(spark, MPD, base=BASE)).first()
    assert (item.status, item.downloadable, item.blocked_reason, item.variants) == ("protected", False, "drm", None)


def test_mpd_segments(spark):
    reps = dash.mpd_representations(manifests(spark, TEMPLATE, LIST, TIMELINE, base=BASE))
    urls = lambda df: [r.segment_url.rsplit("/dash/", 1)[1] for r in df.orderBy("segment_index").collect()]
    assert urls(dash.expand_number_template(reps)) == ["w/n04_0004.m4s", "w/n05_0005.m4s", "w/n06_0006.m4s", "w/n07_0007.m4s"]
    assert urls(dash.expand_segment_list(reps)) == ["part-a.m4s", "part-b.m4s"]
    assert urls(dash.expand_timeline(reps)) == ["5-1.m4s", "25-2.m4s", "45-3.m4s"]
    assert urls(dash.expand_timeline(reps, honor_r=True)) == ["5-1.m4s", "25-2.m4s", "35-3.m4s", "45-4.m4s"]
    assert sorted(urls_ for urls_ in (r.init_segment_url.rsplit("/dash/", 1)[1] for r in dash.init_segments(reps).collect())) == ["open.mp4", "w/head.mp4"]
    item = dash.dash_items(manifests(spark, TEMPLATE, base=BASE)).first()
    assert [(v.variant_id, v.segment_count) for v in item.variants] == [("w", 4)]


def test_mpd_errors(spark):
    rows = dash.mpd_representations(manifests(spark, "junk", "<html></html>", "<MPD><Period/></MPD>", "<MPD type='static'><Period>", base=BASE)).collect()
    got = {r.manifest_id: r.parse_error for r in rows}
    assert got[0] == got[1] == "no MPD element" and got[2] == "no representations" and got[3] is not None


def test_recommended(spark):
    df = spark.createDataFrame([(1, 1, 400), (1, 2, 100), (2, 1, 100), (2, 2, 90)], "item bigint, rank int, size_bytes bigint")
    got = {(r.item, r.rank): (r.recommended, r.preselected) for r in hls.recommended_variant(df, item="item").collect()}
    assert got == {(1, 1): (True, False), (1, 2): (False, True), (2, 1): (True, True), (2, 2): (False, False)}


def test_items_take_over_what_their_manifests_say(spark):
    host = "https://media.test/show/"
    stored = spark.createDataFrame([
        (1, host + "all.m3u8?token=a", MASTER), (2, host + "small/list.m3u8", AES + "\n#EXT-X-ENDLIST"), (3, host + "large/list.m3u8", MEDIA),
        (4, host + "live.m3u8", AES), (5, host + "bad.m3u8", "nothing"), (6, host + "one.mpd", TEMPLATE), (7, host + "drm.mpd", MPD), (8, host + "live.m3u8", MEDIA)],
        "manifest_id bigint, url string, body string")
    rows = [(k, host + k, p, "parsing" if p != "progressive" else "ready", True, None) for k, p in (
        ("all.m3u8", "hls"), ("live.m3u8", "hls"), ("bad.m3u8", "hls"), ("gone.m3u8", "hls"), ("one.mpd", "dash"), ("drm.mpd", "dash"), ("large/list.m3u8", "progressive"))]
    found = spark.createDataFrame(rows, "name string, dedup_key string, protocol string, status string, downloadable boolean, blocked_reason string")
    got = {r.name: tuple(r)[3:] for r in analysis.apply_manifests(found, stored).collect()}
    assert got == {
        "all.m3u8": ("ready_encrypted", True, None, "aes128", None, None, 4), "live.m3u8": ("unsupported", False, "live", "aes128", True, 3.0, 1),
        "bad.m3u8": ("parse_failed", True, None, "none", None, None, 0), "gone.m3u8": ("parsing", True, None, None, None, None, None),
        "one.mpd": ("ready", True, None, "none", False, 21.0, 1), "drm.mpd": ("protected", False, "drm", "drm", False, 7209.0, 0),
        "large/list.m3u8": ("ready", True, None, None, None, None, None)}
    probed = {r.playlist_url.rsplit("show/", 1)[1]: (r.duration_sec, r.segment_count, r.encryption, r.live)
              for r in analysis.probe_variants(hls.hls_variants(stored.filter("manifest_id = 1")), stored).collect()}
    assert probed == {"small/list.m3u8": (3.0, 1, "aes128", False), "large/list.m3u8": (13.875, 4, "none", False),
                      "middle/list.m3u8": (None,) * 4, "voice.m3u8": (None,) * 4}


def test_summary_with_stored_manifests(spark):
    from mediatally.plans.flagship import session_media_summary

    log = spark.createDataFrame([(1, 1, 1000, "GET", 200, "http", "https://media.test/show/live.m3u8", "application/vnd.apple.mpegurl", 10)],
                                "request_id bigint, tab_id bigint, ts_ms bigint, method string, status_code int, kind string, url string, content_type string, content_length bigint")
    stored = spark.createDataFrame([(4, "https://media.test/show/live.m3u8", AES)], "manifest_id bigint, url string, body string")
    plain, read = session_media_summary(log).first().asDict(), session_media_summary(log, stored=stored).first().asDict()
    assert {k for k in plain if plain[k] != read[k]} >= {"parsing_count"} and plain["parsing_count"] == 1 and read["parsing_count"] == 0
