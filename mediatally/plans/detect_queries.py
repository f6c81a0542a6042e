"""Queries over request logs: admission, dedup, page loads, merging, attribution, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, urls
from mediatally.operators import admission, dedup, items, logs
from mediatally.plans import flagship
from mediatally.plans.registry import query
from mediatally.plans.tables import table, with_ctes
from mediatally.session import scratch_dir
from mediatally.sources import pages, requests as req

RULES = ["ads.example.org", "Example.NET ", "", "*.example.com"]
FILTERS = admission.Admission(media_type="video", min_size_mb=0.5, max_size_mb=6, domains=["ads.example.org"])

VOLATILE = "['_t','_ts','token','expire','expires','sign','signature','auth_key']"


def sql_norm(u: str) -> str:
    kept = f"list_filter(string_split(split_part({u}, '?', 2), '&'), lambda p: p <> '' AND NOT list_contains({VOLATILE}, lower(split_part(p, '=', 1))))"
    return (f"CASE WHEN {u} NOT LIKE 'http%://%' THEN {u} WHEN len({kept}) = 0 THEN split_part({u}, '?', 1) "
            f"ELSE split_part({u}, '?', 1) || '?' || array_to_string({kept}, '&') END")


def sql_dir(u: str) -> str:
    return f"CASE WHEN contains(split_part({u}, '?', 1), '/') THEN regexp_replace(split_part({u}, '?', 1), '[^/]*$', '') ELSE {u} END"


def sql_host(u: str) -> str:
    return f"nullif(lower(regexp_extract({u}, '^[a-z]+://([^/?#:@ ]+)', 1)), '')"


def sql_title(u: str) -> str:
    name = f"regexp_replace(regexp_extract(split_part({u}, '?', 1), '([^/]*)$', 1), '[.][A-Za-z0-9]{{1,5}}$', '')"
    return f"CASE WHEN {u} NOT LIKE '%://%' THEN '未命名媒体' ELSE coalesce(nullif(left({name}, 100), ''), {sql_host(u)}) END"


MEDIA_RE = r"'\.(mp4|webm|mov|mkv|flv|ts|m4s|mp3|m4a|aac|ogg|m3u8|mpd)(\?|$)', 'i'"
TRACK_RE = r"'^[a-z]+:.*/([^/]+)/([^/]*?)-(\d+)-(\d+)\.(m4s|mp4|ts)$'"
IS_TRACK = f"regexp_matches(split_part(url, '?', 1), {TRACK_RE})"
LOOKS = f"(regexp_matches(url, {MEDIA_RE}) OR coalesce(mime LIKE 'video/%' OR mime LIKE 'audio/%' OR mime LIKE '%mpegurl%' OR mime LIKE '%dash+xml%', false) OR has_range)"
KIND = r"""CASE WHEN url LIKE 'blob:%' THEN 'blob' WHEN regexp_matches(url, '\.(m3u8|mpd)(\?|$)', 'i') OR mime LIKE '%mpegurl%' OR mime LIKE '%dash+xml%' THEN 'manifest'
 WHEN regexp_matches(url, '\.(ts|m4s)(\?|$)', 'i') OR mime LIKE '%mp2t%' THEN 'segment' ELSE 'progressive' END"""
TYPE = r"""CASE WHEN regexp_matches(url, '\.(mp3|m4a|aac|ogg|opus|wav)(\?|$)', 'i') OR mime LIKE 'audio/%' THEN 'audio' ELSE 'video' END"""
NORMALIZED = "normalized AS (SELECT *, split_part(content_type, ';', 1) AS mime, content_length AS size, status_code = 206 AS has_range FROM requests)"
HTTP = NORMALIZED + ", http AS (SELECT * FROM normalized WHERE tab_id >= 0 AND status_code BETWEEN 200 AND 399 AND method <> 'OPTIONS' AND kind = 'http')"
STAGED = """staged AS (SELECT *, sum(CASE WHEN kind = 'nav' THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts_ms, request_id)::BIGINT AS epoch FROM requests)"""


def _normalized(spark, sf) -> DataFrame:
    return req.normalize_request(table(spark, sf, "requests"))


def _http(spark, sf) -> DataFrame:
    return admission.admit_http(_normalized(spark, sf).filter("kind = 'http'"))


def _staged_http(spark, sf) -> DataFrame:
    staged = dedup.navigation_epoch(table(spark, sf, "requests"))
    return req.normalize_request(admission.admit_http(staged.filter("kind = 'http'")))


STAGED_HTTP = STAGED + ", shttp AS (SELECT *, split_part(content_type, ';', 1) AS mime, content_length AS size, status_code = 206 AS has_range FROM staged WHERE tab_id >= 0 AND status_code BETWEEN 200 AND 399 AND method <> 'OPTIONS' AND kind = 'http')"


def _general_hints(spark, sf) -> DataFrame:
    df = _staged_http(spark, sf)
    return df.filter(~urls.is_track_url(F.col("url")) & media.looks_like_media(F.col("url"), F.col("mime"), F.col("has_range")))


HINTS = STAGED_HTTP + f", hints AS (SELECT * FROM shttp WHERE NOT {IS_TRACK} AND {LOOKS})"


@query("s1_read_requests", with_ctes("SELECT request_id, tab_id, frame_id, ts_ms, method, status_code, kind, url FROM requests", "requests"))
def s1(spark, sf):
    names = ["request_id", "tab_id", "frame_id", "ts_ms", "method", "status_code", "kind", "url"]
    folder = scratch_dir(spark, "request-log")
    table(spark, sf, "requests").select(*names).write.json(folder)
    return req.read_requests(spark, folder, "json").select(*names)


@query("s2_normalize_request", with_ctes(f", {NORMALIZED} SELECT request_id, mime, size, has_range FROM normalized", "requests"))
def s2(spark, sf):
    head = lambda name, col: F.struct(F.lit(name).alias("name"), F.col(col).cast("string").alias("value"))
    listed = table(spark, sf, "requests").withColumn(
        "response_headers", F.array(head("Content-Type", "content_type"), head("CONTENT-LENGTH", "content_length")))
    return req.normalize_request(listed).select("request_id", "mime", "size", "has_range")


@query("f1_admit_http", with_ctes(f", {HTTP} SELECT request_id, status_code FROM http", "requests"))
def f1(spark, sf):
    return _http(spark, sf).select("request_id", "status_code")


@query("f2_looks_like_media", with_ctes(f", {HTTP} SELECT request_id, {LOOKS} AS is_media FROM http", "requests"))
def f2(spark, sf):
    return _http(spark, sf).select("request_id", media.looks_like_media(F.col("url"), F.col("mime"), F.col("has_range")).alias("is_media"))


@query("f3_classify_hint", with_ctes(f", {NORMALIZED} SELECT request_id, {KIND} AS hint_kind FROM normalized", "requests"))
def f3(spark, sf):
    return _normalized(spark, sf).select("request_id", media.classify_hint(F.col("url"), F.col("mime")).alias("hint_kind"))


@query("f4_media_type", with_ctes(f", {NORMALIZED} SELECT request_id, {TYPE} AS media_type FROM normalized", "requests"))
def f4(spark, sf):
    return _normalized(spark, sf).select("request_id", media.media_type(F.col("url"), F.col("mime")).alias("media_type"))


_LISTED = f"({sql_host('url')} = 'ads.example.org' OR {sql_host('url')} LIKE '%.ads.example.org' OR {sql_host('url')} = 'example.net' OR {sql_host('url')} LIKE '%.example.net')"


def _hosted(spark, sf):
    return _http(spark, sf).withColumn("host", urls.host_of(F.col("url"))).filter("host IS NOT NULL")


@query("f5_admit_domain", with_ctes(f", {HTTP} SELECT request_id, {sql_host('url')} AS host FROM http WHERE {sql_host('url')} IS NOT NULL AND NOT {_LISTED}", "requests"))
def f5(spark, sf):
    return admission.admit_domain(_hosted(spark, sf), RULES).select("request_id", "host")


@query("f5_admit_domain_whitelist", with_ctes(f", {HTTP} SELECT request_id, {sql_host('url')} AS host FROM http WHERE {_LISTED}", "requests"))
def f5w(spark, sf):
    return admission.admit_domain(_hosted(spark, sf), RULES, "whitelist").select("request_id", "host")


@query("f5_admit_domain_rule_table", with_ctes(f""", {HTTP}, rules AS (SELECT 'cdn' || CAST(n_nationkey AS STRING) || '.Example.com' AS domain FROM nation)
SELECT request_id, {sql_host('url')} AS host FROM http WHERE {sql_host('url')} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM rules WHERE {sql_host('url')} = lower(domain) OR ends_with({sql_host('url')}, '.' || lower(domain)))""", "requests"))
def f5t(spark, sf):
    rules = table(spark, sf, "nation").select(F.concat(F.lit("cdn"), F.col("n_nationkey").cast("string"), F.lit(".Example.com")).alias("domain"))
    return admission.admit_domain(_hosted(spark, sf), rules).select("request_id", "host")


_REASON = f"""CASE WHEN ({KIND}) NOT IN ('progressive', 'blob') THEN NULL WHEN ({TYPE}) = 'audio' THEN 'type' WHEN size < 0.5 * 1048576 THEN 'min_size'
 WHEN size > 6 * 1048576 THEN 'max_size'
 WHEN coalesce(mime, '') = '' AND regexp_extract(lower(split_part(url, '?', 1)), '([^.]*)$', 1) NOT IN ('', 'mp4', 'webm', 'flv', 'mkv', 'ts', 'mp3', 'm4a', 'aac', 'mov', 'm4s')
   AND ({KIND}) = 'progressive' THEN 'extension' END"""


@query("f6_apply_filters", with_ctes(f", {HTTP} SELECT request_id, {_REASON} AS reject_reason FROM http", "requests"))
def f6(spark, sf):
    return admission.apply_filters(_http(spark, sf), FILTERS).select("request_id", "reject_reason")


_GREEDY = """{src}, kept AS (
  SELECT tab_id, b, min(ts_ms) AS ts FROM h GROUP BY tab_id, b
  UNION ALL
  SELECT h.tab_id, h.b, min(h.ts_ms) FROM kept k JOIN h ON h.tab_id = k.tab_id AND h.b = k.b AND h.ts_ms >= k.ts + 60000 GROUP BY h.tab_id, h.b
), deduped AS (
  SELECT * FROM h WHERE EXISTS (SELECT 1 FROM kept k WHERE k.tab_id = h.tab_id AND k.b = h.b AND k.ts = h.ts_ms)
  QUALIFY row_number() OVER (PARTITION BY tab_id, b, ts_ms ORDER BY request_id) = 1
)"""
_H_ALL = "h AS (SELECT *, split_part(url, '?', 1) AS b FROM requests WHERE kind = 'http')"
SQL_W1 = with_ctes(f", {_GREEDY.format(src=_H_ALL)} SELECT request_id, tab_id, ts_ms, url FROM deduped", "requests", recursive=True)


@query("w1_dedup_60s", SQL_W1)
def w1(spark, sf):
    return dedup.dedup_requests(table(spark, sf, "requests").filter("kind = 'http'")).select("request_id", "tab_id", "ts_ms", "url")


@query("w2_navigation_epoch", with_ctes(f", {STAGED} SELECT request_id, tab_id, epoch FROM staged", "requests"))
def w2(spark, sf):
    return dedup.navigation_epoch(table(spark, sf, "requests")).select("request_id", "tab_id", "epoch")


@query("j11_page_context_asof", with_ctes(f"""
SELECT request_id, last_value(CASE WHEN kind = 'nav' THEN {sql_host('url')} END IGNORE NULLS) OVER (PARTITION BY tab_id ORDER BY ts_ms, request_id ROWS UNBOUNDED PRECEDING) AS page_host
FROM requests""", "requests"))
def j11(spark, sf):
    return dedup.page_context_asof(table(spark, sf, "requests")).select("request_id", "page_host")


MERGED = HINTS + f""", keyed AS (SELECT *, {sql_norm('url')} AS dedup_key, {KIND} AS k FROM hints),
merged AS (
  SELECT tab_id, epoch, dedup_key, min(ts_ms) AS detected_ms, arg_min(struct_pack(url := url, mime := mime, k := k, size := size), request_id) AS f,
         arg_min(size, request_id) FILTER (WHERE size > 0) AS later_size, count(*) AS hint_count
  FROM keyed WHERE k <> 'segment' GROUP BY tab_id, epoch, dedup_key),
merged_items AS (
  SELECT tab_id, epoch, dedup_key, detected_ms, f.url AS master_url, f.k AS k, f.mime AS mime, CASE WHEN f.k = 'progressive' THEN later_size WHEN f.size > 0 THEN f.size END AS size_estimate, hint_count,
         CASE WHEN f.k <> 'manifest' THEN 'progressive' WHEN regexp_matches(f.url, '\\.mpd(\\?|$)') THEN 'dash' ELSE 'hls' END AS protocol,
         CASE WHEN f.k = 'manifest' THEN 'parsing' ELSE 'ready' END AS status
  FROM merged)"""


@query("a2_merge_items", with_ctes(f""", {MERGED}
SELECT tab_id, epoch, dedup_key, detected_ms, master_url, {sql_title('master_url')} AS title, protocol, status,
       {TYPE.replace('url', 'master_url')} AS media_type, size_estimate, hint_count FROM merged_items""", "requests"))
def a2(spark, sf):
    merged = items.merge_items(_general_hints(spark, sf), session=flagship.SESSION)
    return merged.select("tab_id", "epoch", "dedup_key", "detected_ms", "master_url", "title", "protocol", "status", "media_type", "size_estimate", "hint_count")


def _attributed(spark, sf):
    hints = _general_hints(spark, sf)
    merged = items.merge_items(hints, session=flagship.SESSION)
    segments = hints.filter(media.classify_hint(F.col("url"), F.col("mime")) == "segment")
    return items.attribute_segments(segments, merged.filter("protocol <> 'progressive'"), session=flagship.SESSION)


ATTRIBUTED = MERGED + f""", seg_dirs AS (
  SELECT tab_id, epoch, {sql_dir('dedup_key')} AS dir, count(*) AS segment_count FROM keyed WHERE k = 'segment' GROUP BY ALL),
attributed AS (
  SELECT s.tab_id, s.epoch, s.dir, any_value(s.segment_count) AS segment_count, arg_min(m.dedup_key, m.detected_ms) AS dedup_key
  FROM seg_dirs s LEFT JOIN (SELECT *, {sql_dir('dedup_key')} AS mdir FROM merged_items WHERE protocol <> 'progressive') m
    ON s.tab_id = m.tab_id AND s.epoch = m.epoch AND (starts_with(s.dir, m.mdir) OR starts_with(m.mdir, s.dir))
  GROUP BY s.tab_id, s.epoch, s.dir)"""


@query("j1_attribute_segments", with_ctes(f", {ATTRIBUTED} SELECT tab_id, epoch, dir, segment_count, dedup_key FROM attributed", "requests"))
def j1(spark, sf):
    return _attributed(spark, sf)


@query("a4_segments_per_manifest", with_ctes(f", {ATTRIBUTED} SELECT tab_id, epoch, dedup_key, CAST(sum(segment_count) AS BIGINT) AS segment_count FROM attributed WHERE dedup_key IS NOT NULL GROUP BY ALL", "requests"))
def a4(spark, sf):
    return items.segments_per_manifest(_attributed(spark, sf), session=flagship.SESSION)


@query("j2_attach_parent_manifest", with_ctes(f""", {STAGED_HTTP}, named AS (
  SELECT *, regexp_replace(split_part(url, '?', 1), '/720p/[^/]*$|/v1/[^/]*$', '/') || CASE WHEN url LIKE '%.ts' THEN 'master.m3u8' ELSE 'manifest.mpd' END AS parent
  FROM shttp WHERE url LIKE '%/720p/%' OR url LIKE '%/v1/%')
SELECT tab_id, epoch, parent AS dedup_key, min(ts_ms) AS detected_ms, parent || '?token=x' AS master_url, count(*) AS segment_count,
       CASE WHEN parent LIKE '%.mpd' THEN 'dash' ELSE 'hls' END AS protocol, CASE WHEN parent LIKE '%.mpd' THEN 'manifest' ELSE 'master' END AS title
FROM named GROUP BY tab_id, epoch, parent""", "requests"))
def j2(spark, sf):
    df = _staged_http(spark, sf)
    named = F.col("url").contains("/720p/") | F.col("url").contains("/v1/")
    parent = F.concat(F.regexp_replace("url", r"/720p/[^/]*$|/v1/[^/]*$", "/"),
                      F.when(F.col("url").endswith(".ts"), F.lit("master.m3u8")).otherwise(F.lit("manifest.mpd")), F.lit("?token=x"))
    return items.attach_parent_manifest(df.withColumn("parent_manifest", F.when(named, parent)), session=flagship.SESSION)


def _sql_rounds(n: int) -> str:
    """Names of manifests tested `n` times against what was known before, as CTEs k0, t0, k1, …; times are unique in the log."""
    near = f"(starts_with(s.dir, {sql_dir('k.dedup_key')}) OR starts_with({sql_dir('k.dedup_key')}, s.dir))"
    parts = []
    for i in range(n):
        said = "SELECT tab_id, epoch, parent AS dedup_key, since FROM names" + ("" if i == 0 else f" JOIN t{i - 1} USING (tab_id, epoch, dir) WHERE since <= coalesce(first_ms, since)")
        parts.append(f"""k{i} AS (SELECT tab_id, epoch, dedup_key, min(since) AS since FROM (SELECT tab_id, epoch, dedup_key, detected_ms AS since FROM hinted UNION ALL {said}) GROUP BY ALL),
t{i} AS (SELECT s.tab_id, s.epoch, s.dir, min(k.since) AS first_ms, arg_min(k.dedup_key, k.since) AS first_key
  FROM (SELECT DISTINCT tab_id, epoch, dir FROM segs) s LEFT JOIN k{i} k ON s.tab_id = k.tab_id AND s.epoch = k.epoch AND {near} GROUP BY ALL)""")
    return ",\n".join(parts)


# every third segment names the manifest of its folder, every third one a manifest elsewhere
_NAMED = """CASE WHEN request_id % 3 = 0 THEN regexp_replace(split_part(url, '?', 1), '/720p/[^/]*$|/v1/[^/]*$', '/main.m3u8')
 WHEN request_id % 3 = 1 THEN 'https://alt' || CAST(tab_id % 2 AS VARCHAR) || '.example.com/list/' || CAST(request_id % 5 AS VARCHAR) || '.mpd' END"""


@query("j1_attribute_in_order", with_ctes(f""", {MERGED},
segs AS (SELECT tab_id, epoch, {sql_dir('dedup_key')} AS dir, {_NAMED} AS parent, ts_ms FROM keyed WHERE k = 'segment'),
hinted AS (SELECT tab_id, epoch, dedup_key, detected_ms FROM merged_items WHERE protocol <> 'progressive'),
names AS (SELECT tab_id, epoch, dir, parent, min(ts_ms) AS since FROM segs WHERE parent IS NOT NULL GROUP BY ALL),
{_sql_rounds(4)}
SELECT tab_id, epoch, dir, CASE WHEN parent IS NULL OR first_ms < ts_ms THEN first_key ELSE parent END AS dedup_key, count(*) AS segment_count
FROM segs JOIN t3 USING (tab_id, epoch, dir) GROUP BY ALL""", "requests"))
def j1o(spark, sf):
    hints = _general_hints(spark, sf)
    merged = items.merge_items(hints, session=flagship.SESSION)
    base = F.regexp_replace(F.substring_index("url", "?", 1), r"/720p/[^/]*$|/v1/[^/]*$", "/main.m3u8")
    other = F.concat(F.lit("https://alt"), (F.col("tab_id") % 2).cast("string"), F.lit(".example.com/list/"), (F.col("request_id") % 5).cast("string"), F.lit(".mpd"))
    named = F.when(F.col("request_id") % 3 == 0, base).when(F.col("request_id") % 3 == 1, other)
    segments = hints.filter(media.classify_hint(F.col("url"), F.col("mime")) == "segment").withColumn("parent_manifest", named)
    return items.attribute_in_order(segments, merged.filter("protocol <> 'progressive'"), session=flagship.SESSION).segments


TRACKS = STAGED_HTTP + f""", tracks AS (
  SELECT tab_id, epoch, request_id, ts_ms, url, regexp_extract(split_part(url, '?', 1), {TRACK_RE}, 1) || '/' || regexp_extract(split_part(url, '?', 1), {TRACK_RE}, 2) AS group_id,
         CAST(regexp_extract(split_part(url, '?', 1), {TRACK_RE}, 4) AS BIGINT) AS codec_id
  FROM shttp WHERE {IS_TRACK}),
typed AS (SELECT *, CASE WHEN codec_id >= 30000 AND codec_id < 100000 THEN 'audio' ELSE 'video' END AS track_type FROM tracks),
best AS (
  SELECT tab_id, epoch, group_id, min(ts_ms) AS detected_ms,
         max(codec_id) FILTER (WHERE track_type = 'video') AS video_codec,
         arg_max(url, codec_id * 10000000000 - request_id) FILTER (WHERE track_type = 'video') AS video_url,
         max(codec_id) FILTER (WHERE track_type = 'audio') AS audio_codec,
         arg_max(url, codec_id * 10000000000 - request_id) FILTER (WHERE track_type = 'audio') AS audio_url
  FROM typed GROUP BY tab_id, epoch, group_id HAVING video_codec IS NOT NULL)"""


@query("a9_best_tracks", with_ctes(f", {TRACKS} SELECT * FROM best", "requests"))
def a9(spark, sf):
    return items.best_tracks(_staged_http(spark, sf), by=flagship.SESSION)


@query("j9_pair_tracks", with_ctes(f""", {TRACKS}
SELECT tab_id, epoch, group_id, max(codec_id) FILTER (WHERE track_type = 'video') AS video_codec, max(codec_id) FILTER (WHERE track_type = 'audio') AS audio_codec,
       CASE WHEN video_codec IS NULL THEN 'no_video' WHEN audio_codec IS NULL THEN 'silent' ELSE 'dual' END AS track_state
FROM typed GROUP BY tab_id, epoch, group_id""", "requests"))
def j9(spark, sf):
    tracks = _tracks(spark, sf)
    keys = [*flagship.SESSION, "group_id"]
    return items.pair_tracks(tracks.filter("track_type = 'video'"), tracks.filter("track_type = 'audio'"), keys=keys)


def _tracks(spark, sf):
    df = _staged_http(spark, sf).withColumn("_t", urls.parse_track_url(F.col("url"))).filter("_t IS NOT NULL")
    return df.select(*flagship.SESSION, "request_id", "ts_ms", F.col("_t.group_id").alias("group_id"),
                     F.col("_t.codec_id").alias("codec_id"), F.col("_t.track_type").alias("track_type"))


@query("j9_track_items", with_ctes(f""", {TRACKS}
SELECT tab_id, epoch, 'nolist:' || group_id AS dedup_key, video_url AS master_url, audio_codec IS NOT NULL AS dual, audio_codec IS NULL AS silent,
       CASE WHEN audio_codec IS NULL THEN 1 ELSE 2 END AS track_count, 'v' || video_codec AS video_track, 'a' || audio_codec AS audio_track FROM best""", "requests"))
def j9_items(spark, sf):
    out = items.track_items(items.best_tracks(_staged_http(spark, sf), by=flagship.SESSION), session=flagship.SESSION)
    return out.select("tab_id", "epoch", "dedup_key", "master_url", "dual", "silent", "track_count", "video_track", "audio_track")


@query("j13_await_audio", with_ctes(f""", {TRACKS}
SELECT v.tab_id, v.group_id, v.request_id, min(a.ts_ms) AS audio_ts_ms, min(a.ts_ms) IS NULL AS silent
FROM typed v LEFT JOIN typed a ON a.track_type = 'audio' AND a.tab_id = v.tab_id AND a.group_id = v.group_id AND a.ts_ms BETWEEN v.ts_ms AND v.ts_ms + 12000
WHERE v.track_type = 'video' GROUP BY v.tab_id, v.group_id, v.request_id""", "requests"))
def j13(spark, sf):
    out = items.await_audio(_tracks(spark, sf), keys=["tab_id", "group_id"], width=900_000)
    return out.select("tab_id", "group_id", "request_id", "audio_ts_ms", "silent")


_SUMMARY = """, flag AS (SELECT tab_id, epoch, count(*) AS item_count, count(*) FILTER (WHERE downloadable AND status <> 'parsing') AS downloadable_count,
  count(*) FILTER (WHERE NOT downloadable) AS protected_count, count(*) FILTER (WHERE status = 'parsing') AS parsing_count,
  count(*) FILTER (WHERE protocol = 'progressive') AS progressive_count, count(*) FILTER (WHERE protocol = 'hls') AS hls_count,
  count(*) FILTER (WHERE protocol = 'dash') AS dash_count, CAST(coalesce(sum(segment_count), 0) AS BIGINT) AS segment_count
  FROM listed GROUP BY tab_id, epoch)
SELECT tab_id, epoch, coalesce(item_count, 0) AS item_count, coalesce(downloadable_count, 0) AS downloadable_count, coalesce(protected_count, 0) AS protected_count,
  coalesce(parsing_count, 0) AS parsing_count, coalesce(filtered_count, 0) AS filtered_count, coalesce(progressive_count, 0) AS progressive_count,
  coalesce(hls_count, 0) AS hls_count, coalesce(dash_count, 0) AS dash_count, coalesce(segment_count, 0) AS segment_count
FROM flag FULL JOIN (SELECT tab_id, epoch, count(*) AS filtered_count FROM screened WHERE reject_reason IS NOT NULL GROUP BY tab_id, epoch) r USING (tab_id, epoch)"""

# the flagship's hints: deduped, then domain and filter tests, then the same merge as above
_H_MEDIA = f"h AS (SELECT *, split_part(url, '?', 1) AS b FROM shttp WHERE NOT {IS_TRACK} AND {LOOKS})"
_FLAG_CHAIN = (
    f"{TRACKS}, {_GREEDY.format(src=_H_MEDIA)}, screened AS (SELECT *, {_REASON} AS reject_reason FROM deduped WHERE {sql_host('url')} IS NOT NULL AND {sql_host('url')} <> 'ads.example.org'), "
    "hints AS (SELECT * FROM screened WHERE reject_reason IS NULL)"
    + ATTRIBUTED[len(HINTS):]
    + """, owned AS (SELECT tab_id, epoch, dedup_key, sum(segment_count) AS segment_count FROM attributed WHERE dedup_key IS NOT NULL GROUP BY ALL),
listed AS (
  SELECT m.tab_id, m.epoch, m.protocol, m.status, m.k <> 'blob' AS downloadable, o.segment_count FROM merged_items m LEFT JOIN owned o USING (tab_id, epoch, dedup_key)
  UNION ALL SELECT tab_id, epoch, 'dash', 'ready', true, NULL FROM best)"""
)
SQL_FLAGSHIP = with_ctes(f", {_FLAG_CHAIN} {_SUMMARY}", "requests", recursive=True)


@query("a1_session_summary", SQL_FLAGSHIP)
def a1(spark, sf):
    return flagship.session_media_summary(table(spark, sf, "requests"), FILTERS)


# the same with page hints, which are all taken; segments may name manifests, tested in rounds as for j1_attribute_in_order
_PAGE_CHAIN = (
    f"{TRACKS}, {_GREEDY.format(src=_H_MEDIA)}, screened AS (SELECT *, {_REASON} AS reject_reason FROM deduped WHERE {sql_host('url')} IS NOT NULL AND {sql_host('url')} <> 'ads.example.org'), "
    """told AS (SELECT *, (SELECT count(*) FROM requests n WHERE n.kind = 'nav' AND n.tab_id = p.tab_id AND n.ts_ms <= p.ts_ms) AS epoch FROM page_hints p WHERE tab_id >= 0),
hints AS (SELECT tab_id, epoch, request_id, ts_ms, url, mime, size, NULL::VARCHAR AS parent_manifest FROM screened WHERE reject_reason IS NULL
  UNION ALL SELECT tab_id, epoch, request_id, ts_ms, url, mime, size, parent_manifest FROM told)"""
    + MERGED[len(HINTS):]
    + f""", segs AS (SELECT tab_id, epoch, {sql_dir('dedup_key')} AS dir, {sql_norm('parent_manifest')} AS parent, ts_ms FROM keyed WHERE k = 'segment'),
hinted AS (SELECT tab_id, epoch, dedup_key, detected_ms FROM merged_items WHERE protocol <> 'progressive'),
names AS (SELECT tab_id, epoch, dir, parent, min(ts_ms) AS since FROM segs WHERE parent IS NOT NULL GROUP BY ALL), {_sql_rounds(4)},
owned AS (SELECT tab_id, epoch, dedup_key, count(*) AS segment_count FROM (
  SELECT tab_id, epoch, CASE WHEN parent IS NULL OR first_ms < ts_ms THEN first_key ELSE parent END AS dedup_key FROM segs JOIN t3 USING (tab_id, epoch, dir)) WHERE dedup_key IS NOT NULL GROUP BY ALL),
named AS (SELECT DISTINCT tab_id, epoch, parent AS dedup_key FROM names JOIN t3 USING (tab_id, epoch, dir) WHERE since <= coalesce(first_ms, since)),
listed AS (
  SELECT m.tab_id, m.epoch, m.protocol, m.status, m.k <> 'blob' AS downloadable, o.segment_count FROM merged_items m LEFT JOIN owned o USING (tab_id, epoch, dedup_key)
  UNION ALL SELECT tab_id, epoch, 'dash', 'ready', true, NULL FROM best
  UNION ALL SELECT n.tab_id, n.epoch, 'dash', 'parsing', true, o.segment_count FROM named n LEFT JOIN owned o USING (tab_id, epoch, dedup_key)
    WHERE (n.tab_id, n.epoch, n.dedup_key) NOT IN (SELECT (tab_id, epoch, dedup_key) FROM hinted))"""
)


@query("a1_session_summary_with_pages", with_ctes(f", {_PAGE_CHAIN} {_SUMMARY}", "requests", "page_hints", recursive=True))
def a1_pages(spark, sf):
    return flagship.session_media_summary(table(spark, sf, "requests"), FILTERS, page_hints=table(spark, sf, "page_hints"))


SQL_PAGES = with_ctes("""
SELECT page_id, 'video' AS tag, '/media/clip-' || CAST(page_id % 50 AS STRING) || '.mp4' AS src, regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/media/clip-' || CAST(page_id % 50 AS STRING) || '.mp4' AS url,
       false AS is_blob, regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/p/' || CAST(page_id AS STRING) || '.jpg' AS poster_url, 'Clip ' || CAST(page_id AS STRING) AS title
FROM media_pages WHERE contains(html, '/media/clip-')
UNION ALL
SELECT page_id, 'source', 'https://files.example.net/a-' || CAST(page_id % 20 AS STRING) || '.mp3', 'https://files.example.net/a-' || CAST(page_id % 20 AS STRING) || '.mp3', false, NULL, NULL
FROM media_pages WHERE contains(html, 'files.example.net/a-')
UNION ALL
SELECT page_id, 'video', 'blob:https://x.example.com/' || CAST(page_id AS STRING), 'blob:https://x.example.com/' || CAST(page_id AS STRING), true, NULL, NULL
FROM media_pages WHERE contains(html, 'blob:https://x.example.com/')
UNION ALL
SELECT page_id, 'source', 'stream/' || CAST(page_id AS STRING) || '/master.m3u8', regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'stream/' || CAST(page_id AS STRING) || '/master.m3u8', false, NULL, NULL
FROM media_pages WHERE contains(html, '<source src="stream/')""", "media_pages")


@query("s3_scan_pages", SQL_PAGES)
def s3(spark, sf):
    return pages.scan_pages(table(spark, sf, "media_pages")).select("page_id", "tag", "src", "url", "is_blob", "poster_url", "title")


@query("u1_union_hints", with_ctes(f""", {HTTP}
SELECT source, media_type, count(*) AS hints FROM (
  SELECT 'network' AS source, {TYPE} AS media_type FROM http WHERE {LOOKS}
  UNION ALL SELECT 'page', 'video' FROM media_pages WHERE contains(html, '/media/clip-')
  UNION ALL SELECT 'page', 'audio' FROM media_pages WHERE contains(html, 'files.example.net/a-')
  UNION ALL SELECT 'page', 'video' FROM media_pages WHERE contains(html, 'blob:https://x.example.com/')
  UNION ALL SELECT 'page', 'video' FROM media_pages WHERE contains(html, '<source src="stream/')) u GROUP BY source, media_type""", "requests", "media_pages"))
def u1(spark, sf):
    hints = _union(spark, sf)
    return hints.groupBy("source", "media_type").agg(F.count(F.lit(1)).alias("hints"))


def _union(spark, sf):
    network = _http(spark, sf).filter(media.looks_like_media(F.col("url"), F.col("mime"), F.col("has_range")))
    network = network.select("request_id", "tab_id", "url", "mime", F.lit("network").alias("source"))
    page = pages.scan_pages(table(spark, sf, "media_pages")).select("page_id", "url", "is_blob", "title", F.lit("page").alias("source"))
    return items.union_hints(network, page).withColumn("media_type", media.media_type(F.col("url"), F.col("mime")))


@query("a14_detection_counts", with_ctes(f""", {HTTP}
SELECT source, media_type, protocol, count(*) AS hints FROM (
  SELECT 'network' AS source, {TYPE} AS media_type, CASE WHEN ({KIND}) <> 'manifest' THEN 'progressive' WHEN url LIKE '%.mpd%' THEN 'dash' ELSE 'hls' END AS protocol FROM http WHERE {LOOKS}
  UNION ALL SELECT 'page', 'video', 'progressive' FROM media_pages WHERE contains(html, '/media/clip-')
  UNION ALL SELECT 'page', 'audio', 'progressive' FROM media_pages WHERE contains(html, 'files.example.net/a-')
  UNION ALL SELECT 'page', 'video', 'progressive' FROM media_pages WHERE contains(html, 'blob:https://x.example.com/')
  UNION ALL SELECT 'page', 'video', 'hls' FROM media_pages WHERE contains(html, '<source src="stream/')) u GROUP BY ALL""", "requests", "media_pages"))
def a14_detected(spark, sf):
    is_manifest = media.classify_hint(F.col("url"), F.col("mime")) == "manifest"
    protocol = F.when(is_manifest, media.manifest_protocol(F.col("url"), F.col("mime"))).otherwise(F.lit("progressive"))
    return logs.detection_counts(_union(spark, sf).withColumn("protocol", protocol))


@query("a14_filter_hits", with_ctes(f", {HTTP}, screened AS (SELECT {_REASON} AS reject_reason FROM http) SELECT reject_reason, count(*) AS hits FROM screened WHERE reject_reason IS NOT NULL GROUP BY reject_reason", "requests"))
def a14_filtered(spark, sf):
    return logs.filter_hits(admission.apply_filters(_http(spark, sf), FILTERS).filter("reject_reason IS NOT NULL"))


@query("s7_import_domains", with_ctes("""
SELECT domain, regexp_matches(domain, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{2,}$') AS valid, count(*) AS lines FROM (
  SELECT lower(trim(CASE WHEN page_id % 5 = 0 THEN url ELSE ' ' || upper(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) || ' ' END)) AS domain FROM pages) d GROUP BY domain"""))
def s7(spark, sf):
    return admission.import_domains(_domain_lines(spark, sf)).groupBy("domain", "valid").agg(F.count(F.lit(1)).alias("lines"))


def _domain_lines(spark, sf):
    host = F.concat(F.lit(" "), F.upper(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)), F.lit(" "))
    return table(spark, sf, "pages").select(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(host).alias("value"))


@query("a15_distinct_union_domains", with_ctes("""
SELECT 'site' || CAST(n_nationkey AS STRING) || '.example' AS domain FROM nation
UNION SELECT domain FROM (
  SELECT lower(trim(CASE WHEN page_id % 5 = 0 THEN url ELSE ' ' || upper(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) || ' ' END)) AS domain FROM pages) d
WHERE regexp_matches(domain, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{2,}$')"""))
def a15(spark, sf):
    existing = table(spark, sf, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("domain"))
    return admission.union_domains(existing, admission.import_domains(_domain_lines(spark, sf)))


@query("s8_upsert_items", with_ctes(f""", {HTTP}
SELECT tab_id, {sql_norm('url')} AS dedup_key, min(ts_ms) AS detected_ms, arg_max(url, request_id) AS url, arg_max(status_code, request_id) AS status_code
FROM http GROUP BY ALL""", "requests"))
def s8(spark, sf):
    df = _http(spark, sf).withColumn("dedup_key", urls.normalize_url(F.col("url"))).withColumn("detected_ms", F.col("ts_ms"))
    out = items.upsert_items(df.select("tab_id", "dedup_key", "detected_ms", "url", "status_code", "ts_ms", "request_id"),
                             keys=["tab_id", "dedup_key"], order=["ts_ms", "request_id"], first="detected_ms")
    return out.select("tab_id", "dedup_key", "detected_ms", "url", "status_code")


@query("r5_state_ttl", with_ctes("""
, saves AS (SELECT tab_id, max(ts_ms) * 10 - max(max(ts_ms) * 9) OVER () AS saved_ms FROM requests GROUP BY tab_id)
SELECT tab_id, saved_ms FROM saves WHERE (SELECT max(saved_ms) FROM saves) - saved_ms <= 600000""", "requests"))
def r5(spark, sf):
    # ages are stretched by ten and the limit set to ten minutes, so that the short synthetic log has expired tabs
    last = table(spark, sf, "requests").groupBy("tab_id").agg(F.max("ts_ms").alias("ts"))
    now = table(spark, sf, "requests").agg(F.max("ts_ms").alias("now")).scalar()
    saves = last.select("tab_id", (F.col("ts") * 10 - now * 9).alias("saved_ms"))
    return dedup.live_states(saves, now, ttl_ms=600_000).select("tab_id", "saved_ms")
