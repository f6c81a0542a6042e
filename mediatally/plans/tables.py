"""Input tables derived from the driver's parquet files.

Each recipe is one SELECT in the SQL subset that Spark and DuckDB share, with `{name}` marking the
tables it reads. Spark runs it over DataFrames, the oracle repeats it as a CTE, so that both engines
work on the same whole tables. Times are synthetic integer milliseconds taken from ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The one construct the engines spell differently.
_DIALECT = {
    "spark": {"each_attempt": "explode(array(0, 1, 2, 3))"},
    "duckdb": {"each_attempt": "unnest([0, 1, 2, 3])"},
}

RECIPES: dict[str, str] = {
    # lineitem repeats (l_orderkey, l_linenumber); one row per key
    "li_src": """
SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
       min(l_extendedprice) AS l_extendedprice, min(l_quantity) AS l_quantity
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "requests_src": """
SELECT event_id AS request_id, user_id % 40 AS tab_id, CAST(event_id % 3 AS INT) AS frame_id,
       1704067200000 + event_id * 40 AS ts_ms,
       event_id % 20 AS k, user_id % 3 AS h, user_id % 10 AS v, event_type, value
FROM {events}""",
    "requests": """
SELECT request_id, tab_id, frame_id, ts_ms,
       CASE WHEN k = 17 AND h = 1 THEN 'OPTIONS' ELSE 'GET' END AS method,
       CASE WHEN event_type = 'error' AND k < 4 THEN 404
            WHEN k IN (8, 9, 10, 11) THEN 206 ELSE 200 END AS status_code,
       CASE WHEN event_type = 'signup' AND k = 0 THEN 'nav' ELSE 'http' END AS kind,
       CASE k
         WHEN 0 THEN concat('https://www.site', CAST(h AS STRING), '.example.com/watch/', CAST(v AS STRING))
         WHEN 1 THEN concat('https://cdn', CAST(h AS STRING), '.example.com/vod/', CAST(v AS STRING), '/master.m3u8?token=', CAST(request_id AS STRING))
         WHEN 2 THEN concat('https://cdn', CAST(h AS STRING), '.example.com/dash/', CAST(v AS STRING), '/manifest.mpd?expires=', CAST(ts_ms AS STRING), '&id=', CAST(v AS STRING))
         WHEN 3 THEN concat('https://files', CAST(h AS STRING), '.example.net/song-', CAST(v AS STRING), '.mp3')
         WHEN 4 THEN concat('https://files', CAST(h AS STRING), '.example.net/clip-', CAST(v AS STRING), '.mp4?_t=', CAST(ts_ms AS STRING), '&q=hd')
         WHEN 5 THEN concat('https://ads.example.org/banner-', CAST(v AS STRING), '.webm')
         WHEN 6 THEN concat('https://api', CAST(h AS STRING), '.example.com/stream?id=', CAST(v AS STRING))
         WHEN 7 THEN concat('https://img.example.org/poster-', CAST(v AS STRING), '.jpg')
         WHEN 8 THEN concat('https://n', CAST(h AS STRING), '.bcdn.example/res/', CAST(v AS STRING), '/', CAST(v AS STRING), '_a-1-', CAST(100020 + request_id % 7 AS STRING), '.m4s?sig=', CAST(request_id AS STRING))
         WHEN 9 THEN concat('https://n', CAST(h AS STRING), '.bcdn.example/res/', CAST(v AS STRING), '/', CAST(v AS STRING), '_a-1-', CAST(30210 + request_id % 7 AS STRING), '.m4s?sig=', CAST(request_id AS STRING))
         WHEN 18 THEN 'not a url'
         WHEN 19 THEN concat('https://cdn', CAST(h AS STRING), '.example.com/dash/', CAST(v AS STRING), '/v1/s', CAST(request_id % 50 AS STRING), '.m4s')
         ELSE concat('https://cdn', CAST(h AS STRING), '.example.com/vod/', CAST(v AS STRING), '/720p/seg-', CAST(request_id % 50 AS STRING), '.ts')
       END AS url,
       CASE k WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/vnd.apple.mpegurl' WHEN 2 THEN 'application/dash+xml'
              WHEN 3 THEN 'audio/mpeg' WHEN 4 THEN 'video/mp4' WHEN 5 THEN 'video/webm' WHEN 6 THEN 'audio/mp4; codecs=mp4a' WHEN 7 THEN 'image/jpeg'
              WHEN 18 THEN NULL ELSE 'video/mp2t' END AS content_type,
       CASE WHEN k IN (6, 18) THEN NULL ELSE CAST(floor(value * 100000) AS BIGINT) END AS content_length
FROM {requests_src}""",
    # what page scripts report: segments that name a manifest elsewhere, blobs, plain files
    "page_hints": """
SELECT request_id + 1000000000 AS request_id, tab_id, ts_ms + 7 AS ts_ms,
       CASE k WHEN 12 THEN concat('https://cdn', CAST(h AS STRING), '.example.com/vod/', CAST(v AS STRING), '/720p/own-', CAST(request_id AS STRING), '.ts')
              WHEN 13 THEN concat('blob:https://www.site', CAST(h AS STRING), '.example.com/', CAST(v AS STRING))
              ELSE concat('https://pages', CAST(h AS STRING), '.example.org/movie-', CAST(v AS STRING), '.mp4') END AS url,
       CASE WHEN k = 14 THEN 'video/mp4' END AS mime, CAST(NULL AS BIGINT) AS size,
       CASE WHEN k = 12 AND v < 8 THEN concat('https://list', CAST(h AS STRING), '.example.com/p/', CAST(v AS STRING), '.mpd?token=', CAST(request_id AS STRING)) END AS parent_manifest,
       CASE WHEN k = 14 THEN 'A film' END AS page_title
FROM {requests_src} WHERE k IN (12, 13, 14)""",
    # saves of tab states, with pauses of many hours
    "tab_saves": """
SELECT user_id AS tab_id, 1704067200000 + event_id * 60000 + user_id % 7 AS saved_ms FROM {events}""",
    "fetch_attempts": """
SELECT task_id, segment_index, attempt,
       CASE WHEN (l_partkey + attempt) % 11 = 0 THEN 503
            WHEN (l_suppkey + attempt) % 13 = 0 THEN 0
            WHEN l_partkey % 29 = 0 THEN 404
            WHEN task_id % 97 = 0 AND segment_index = 1 THEN 403
            ELSE 200 END AS status_code,
       bytes
FROM (SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS segment_index, l_partkey, l_suppkey,
             CAST(floor(l_extendedprice) AS BIGINT) AS bytes, {each_attempt} AS attempt
      FROM {li_src}) a""",
    "tasks": """
SELECT o_orderkey AS task_id, o_custkey AS media_id, o_custkey % 40 AS tab_id, 1704067200000 + o_orderkey * 250 AS created_ms,
       CASE WHEN o_orderkey % 9 < 4 THEN 'done' WHEN o_orderkey % 9 = 4 THEN 'failed' WHEN o_orderkey % 9 = 5 THEN 'downloading'
            WHEN o_orderkey % 9 = 6 THEN 'paused' WHEN o_orderkey % 9 = 7 THEN 'merging' ELSE 'canceled' END AS stage,
       CASE o_custkey % 3 WHEN 0 THEN 'progressive' WHEN 1 THEN 'hls' ELSE 'dash' END AS protocol,
       CAST(floor(o_totalprice * 1000) AS BIGINT) AS total_bytes
FROM {orders}""",
    "task_events": """
SELECT task_id, CAST(0 AS BIGINT) AS seq, created_ms AS ts_ms, 'queued' AS stage FROM {tasks}
UNION ALL
SELECT task_id, CAST(1 AS BIGINT), created_ms + 400 + task_id % 600, 'downloading' FROM {tasks}
UNION ALL
SELECT task_id, CAST(2 AS BIGINT), created_ms + 5000 + media_id % 900, CASE protocol WHEN 'hls' THEN 'decrypting' ELSE 'merging' END FROM {tasks}
UNION ALL
SELECT task_id, CAST(3 AS BIGINT), created_ms + 9000 + media_id % 700, stage FROM {tasks}""",
    # segment 0 of every task is its init segment
    "segment_store": """
SELECT task_id, segment_index, max(bytes) AS bytes FROM {fetch_attempts} WHERE status_code = 200
GROUP BY task_id, segment_index""",
    "fragments": """
SELECT l_orderkey AS file_id, CAST(l_linenumber % 2 + 1 AS INT) AS track_id, CAST(l_linenumber AS BIGINT) AS seq,
       CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) * 9000 END AS decode_time,
       CAST(floor(l_quantity) AS BIGINT) AS sample_size, CAST(l_suppkey % 3 AS BIGINT) * 10 + 3000 AS sample_duration
FROM {li_src}""",
    "samples": """
SELECT l_orderkey AS file_id, CAST(l_linenumber % 2 + 1 AS INT) AS track_id, CAST(l_linenumber AS BIGINT) AS seq,
       CAST(l_linenumber AS BIGINT) * 65536 + l_partkey % 50 AS src_offset,
       CAST(floor(l_quantity) AS BIGINT) AS sample_size, CAST(l_suppkey % 2 AS BIGINT) * 10 + 3000 AS sample_duration,
       CASE WHEN l_partkey % 5 = 0 THEN 512 ELSE 0 END AS cts_offset, l_partkey % 3 = 0 AS is_sync
FROM {li_src}""",
    "stream_types": """
SELECT l_orderkey AS segment_id,
       CASE l_partkey % 9 WHEN 0 THEN 27 WHEN 1 THEN 36 WHEN 2 THEN 2 WHEN 3 THEN 15 WHEN 4 THEN 129 WHEN 5 THEN 3
                          WHEN 6 THEN 17 WHEN 7 THEN 27 ELSE 6 END AS stream_type
FROM {li_src}""",
    # of three playlists in a row the first lists two renditions, the others hold parts; every eleventh is a web page
    "manifests": """
SELECT doc_id AS manifest_id, concat('https://edge', CAST(doc_id % 5 AS STRING), '.media.test/hls/', CAST(doc_id AS STRING), '/top.m3u8') AS url,
       CASE WHEN doc_id % 11 = 7 THEN '<html>gone</html>'
       WHEN doc_id % 3 = 0 THEN concat('#EXTM3U', chr(10), '#EXT-X-INDEPENDENT-SEGMENTS', chr(10),
            '#EXT-X-STREAM-INF:RESOLUTION=768x432,BANDWIDTH=', CAST(640000 + n_chars AS STRING), chr(10), '# small', chr(10), 'small/list.m3u8', chr(10),
            '#EXT-X-STREAM-INF:CODECS="vp09.00.50.08,opus",BANDWIDTH=7300000,RESOLUTION=2560x1440', chr(10), 'large/list.m3u8', chr(10))
       ELSE concat('#EXTM3U', chr(10), '#EXT-X-TARGETDURATION:', CAST(doc_id % 4 + 6 AS STRING), chr(10), '#EXT-X-MEDIA-SEQUENCE:', CAST(doc_id % 311 AS STRING), chr(10),
            CASE doc_id % 5 WHEN 1 THEN concat('#EXT-X-KEY:METHOD=AES-128,URI="https://vault.test/k/', CAST(doc_id AS STRING), '",IV=0x0f1e2d3c4b5a69788796a5b4c3d2e1f0', chr(10))
                            WHEN 3 THEN concat('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://vault/', CAST(doc_id AS STRING), '"', chr(10)) ELSE '' END,
            repeat(concat('#EXTINF:6.25,', chr(10),
                          CASE doc_id % 8 WHEN 4 THEN concat('#EXT-X-BYTERANGE:', CAST(n_chars + 1 AS STRING), chr(10))
                                          WHEN 2 THEN concat('#EXT-X-BYTERANGE:', CAST(n_chars + 1 AS STRING), '@', CAST(doc_id AS STRING), chr(10)) ELSE '' END,
                          'part-', lang, '.ts', chr(10)), CAST(doc_id % 7 + 1 AS INT)),
            CASE WHEN doc_id % 6 = 5 THEN '' ELSE '#EXT-X-ENDLIST' END) END AS body
FROM {documents}""",
    "logs": """
SELECT event_id AS log_id, 1704067200000 + event_id * 40 AS ts_ms,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'DEBUG' ELSE 'INFO' END AS level,
       CASE event_id % 7 WHEN 0 THEN 'detector' WHEN 1 THEN 'analyzer' WHEN 2 THEN 'downloader' WHEN 3 THEN 'processor' WHEN 4 THEN 'engine' WHEN 5 THEN 'storage' ELSE 'ui' END AS module,
       concat('step ', event_type, ' task=', CAST(user_id AS STRING)) AS msg,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('https://cdn.example.com/a/b/c/d/', CAST(event_id AS STRING), '.ts?token=', CAST(user_id AS STRING)) END AS detail
FROM {events}""",
    "media_pages": """
SELECT page_id, url,
       CASE page_id % 4
         WHEN 0 THEN concat('<video poster="/p/', CAST(page_id AS STRING), '.jpg" src="/media/clip-', CAST(page_id % 50 AS STRING), '.mp4" title="Clip ', CAST(page_id AS STRING), '"></video>', html)
         WHEN 1 THEN concat('<audio><source src="https://files.example.net/a-', CAST(page_id % 20 AS STRING), '.mp3"></audio><video src="blob:https://x.example.com/', CAST(page_id AS STRING), '"></video>', html)
         WHEN 2 THEN concat('<video><source src="stream/', CAST(page_id AS STRING), '/master.m3u8"></video><video src="/player"></video>', html)
         ELSE html END AS html
FROM {pages}""",
    # four shapes in turn: templates of the set with real repeats and jumps; two periods with lists; prefixed names; entries longer than
    # a segment and a representation without id or segments. Of thirteen documents one is cut off and one is a web page
    "mpd_manifests": """
SELECT doc_id AS manifest_id, concat('https://edge', CAST(doc_id % 5 AS STRING), '.media.test/d/', CAST(doc_id AS STRING), '/show.mpd') AS url,
  CASE WHEN doc_id % 13 = 12 THEN '<html><p>moved</p></html>' WHEN doc_id % 13 = 11 THEN '<MPD type="static"><Period>' ELSE concat(
    CASE WHEN doc_id % 4 = 2 THEN '<m:MPD xmlns:m="urn:mpeg:dash:schema:mpd:2011" type="' ELSE '<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="' END,
    CASE WHEN doc_id % 9 = 4 THEN 'dynamic' ELSE 'static' END, '" mediaPresentationDuration="PT', CAST(doc_id % 3 AS STRING), 'M', CAST(doc_id % 45 + 15 AS STRING), '.5S">',
    CASE doc_id % 4
    WHEN 0 THEN concat('<Period><AdaptationSet contentType="video" mimeType="video/webm">',
      CASE WHEN doc_id % 3 = 0 THEN '<ContentProtection schemeIdUri="urn:uuid:00000000-test"/>' ELSE '' END,
      '<SegmentTemplate timescale="90000" duration="360000" startNumber="', CAST(doc_id % 3 + 1 AS STRING), '" initialization="v/$RepresentationID$/head.webm" media="v/$RepresentationID$/$Number%04d$.webm"/>',
      '<Representation id="lo" bandwidth="', CAST(700000 + n_chars AS STRING), '" width="768" height="432" codecs="vp09.00.30.08"/><Representation id="hi" bandwidth="5200000" width="2560" height="1440"/></AdaptationSet>',
      '<AdaptationSet mimeType="audio/webm" lang="', lang, '"><Representation id="snd" bandwidth="96000" codecs="opus"><SegmentTemplate timescale="48000" initialization="snd/head" media="snd/$Time$.bin">',
      '<SegmentTimeline><S t="1200" d="96000" r="2"/><S d="48000"/><S t="500000" d="96000" r="1"/></SegmentTimeline></SegmentTemplate></Representation></AdaptationSet></Period></MPD>')
    WHEN 1 THEN concat('<Period><AdaptationSet contentType="video"><Representation id="take-a" bandwidth="3100000" width="1600" height="900"><SegmentList duration="5">',
      '<Initialization sourceURL="head-a.bin"/><SegmentURL media="a/one.bin"/><SegmentURL media="a/two.bin"/><SegmentURL media="a/three.bin"/></SegmentList></Representation></AdaptationSet></Period>',
      '<Period><AdaptationSet><Representation id="voice" bandwidth="', CAST(48000 + doc_id % 100 AS STRING), '"><AudioChannelConfiguration value="2"/><SegmentList timescale="10" duration="50"><SegmentURL media="/abs/',
      CAST(doc_id AS STRING), '.bin"/></SegmentList></Representation></AdaptationSet></Period></MPD>')
    WHEN 2 THEN '<m:Period><m:AdaptationSet contentType="video"><m:Representation id="only" bandwidth="1234567" width="1024" height="576"><m:SegmentTemplate timescale="1" duration="8" media="$Bandwidth$-$Number$.bin"/></m:Representation></m:AdaptationSet></m:Period></m:MPD>'
    ELSE concat('<Period><AdaptationSet contentType="video"><Representation id="t1" bandwidth="2200000" width="1366" height="768"><SegmentTemplate timescale="1000" duration="4000" media="t/$Time%09d$.bin"><SegmentTimeline>',
      '<S d="8000"/><S t="9000" d="4000"/></SegmentTimeline></SegmentTemplate></Representation><Representation bandwidth="900000"/></AdaptationSet></Period></MPD>') END) END AS body
FROM {documents}""",
    # listed items with sizes, durations and page titles, one per customer
    "items": """
SELECT c_custkey AS media_id, c_custkey % 40 AS tab_id,
       CASE c_custkey % 3 WHEN 0 THEN 'progressive' WHEN 1 THEN 'hls' ELSE 'dash' END AS protocol,
       CASE WHEN c_custkey % 6 = 3 THEN 'audio' ELSE 'video' END AS media_type,
       concat(c_mktsegment, ': part ', CAST(c_custkey % 100 AS STRING), CASE WHEN c_custkey % 4 = 0 THEN ' - 高清在线' ELSE '' END) AS page_title,
       concat('https://cdn', CAST(c_custkey % 5 AS STRING), '.example.com/v/', CAST(c_custkey AS STRING), '/',
              CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 'track.m4a?k=1' ELSE 'clip.mp4?k=1' END
                                 WHEN 1 THEN 'index.m3u8' ELSE 'manifest.mpd' END) AS master_url,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey * 7 % 20000 AS DOUBLE) + 0.25 END AS duration_sec,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal * 100000) AS BIGINT) END AS size_bytes,
       CASE c_custkey % 8 WHEN 0 THEN '3840x2160' WHEN 1 THEN '1920x1080' WHEN 2 THEN '1280x720' WHEN 3 THEN '854x480' WHEN 4 THEN '640x360'
                          WHEN 5 THEN '320x200' WHEN 6 THEN NULL ELSE '2560x1440' END AS resolution,
       CASE c_custkey % 11 WHEN 0 THEN 'drm' WHEN 1 THEN 'sampleaes' WHEN 2 THEN 'aes128' ELSE 'none' END AS encryption,
       c_custkey % 13 = 5 AS live, c_custkey % 17 = 4 AS is_parsing, c_custkey % 19 = 6 AS is_failed,
       c_custkey % 3 AS track_count, 1704067200000 + c_custkey * 60000 AS detected_ms
FROM {customer}""",
}

_REF = re.compile(r"\{(\w+)\}")


def deps(name: str) -> list[str]:
    return [ref for ref in dict.fromkeys(_REF.findall(RECIPES[name])) if ref not in _DIALECT["spark"]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one, as a lazy DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return derived(spark, name, {dep: table(spark, sf_dir, dep) for dep in deps(name)})


def derived(spark: SparkSession, name: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """A recipe over given inputs. The row is rebuilt by `inline`, so that its columns are values as in a
    stored table: without it the optimizer copies the recipe's long CASE texts into every later expression."""
    sql = RECIPES[name]
    for marker, text in _DIALECT["spark"].items():
        sql = sql.replace("{" + marker + "}", text)
    rows = spark.sql(sql, **inputs)
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def with_ctes(body: str, *names: str, recursive: bool = False) -> str:
    """Oracle text: the named derived tables as CTEs in front of `body` (which may add its own after a comma)."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in ordered:
            return
        for dep in deps(name):
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        sql = RECIPES[name]
        for marker, text in _DIALECT["duckdb"].items():
            sql = sql.replace("{" + marker + "}", text)
        parts.append(f"{name} AS ({_REF.sub(lambda m: m.group(1), sql)})")
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if not parts:
        return head + body[1:].strip() if body.startswith(",") else body
    return head + ",\n".join(parts) + ("" if body.startswith(",") else "\n") + body
