"""Queries for the column functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, sql, text, urls
from mediatally.operators import items as item_ops
from mediatally.operators import logs as log_ops
from mediatally.plans.detect_queries import STAGED_HTTP, TRACK_RE, TYPE, sql_dir, sql_host, sql_norm, sql_title
from mediatally.plans.registry import query
from mediatally.plans.tables import table, with_ctes
from mediatally.sources import segments

_ALL = r"[/\\:*?\"<>|\x00-\x1f]"


def _requests(spark, sf) -> DataFrame:
    return table(spark, sf, "requests")


@query("x1_normalize_url", with_ctes(f"SELECT request_id, {sql_norm('url')} AS normalized FROM requests", "requests"))
def x1(spark, sf):
    return _requests(spark, sf).select("request_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query("x2_dir_of", with_ctes(f"SELECT request_id, {sql_dir('url')} AS dir FROM requests", "requests"))
def x2(spark, sf):
    return _requests(spark, sf).select("request_id", urls.dir_of(F.col("url")).alias("dir"))


@query("x3_title_from_url", with_ctes(f"SELECT request_id, {sql_title('url')} AS title FROM requests", "requests"))
def x3(spark, sf):
    return _requests(spark, sf).select("request_id", urls.title_from_url(F.col("url")).alias("title"))


@query("x4_clean_title", r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[/\\:*?"<>|\x00-\x1f]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')), 100) AS title FROM documents""")
def x4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_title(F.col("text")).alias("title"))


_PAGE_TITLE = r"""left(trim(regexp_replace(regexp_replace(regexp_replace(page_title, '[/\\:*?"<>|]', '', 'g'), '\s*[-_|]\s*(视频|高清|正版|官方|网站|官网|平台|APP|app).*$', ''), '\s+', ' ', 'g')), 100)"""


@query("x5_derive_title", with_ctes(f"""
SELECT media_id, CASE WHEN media_id % 5 = 0 THEN regexp_replace(regexp_extract(split_part(master_url, '?', 1), '([^/]*)$', 1), '[.][a-z0-9]+$', '')
  WHEN media_id % 5 = 1 THEN {sql_host('master_url')} || '-' || strftime(epoch_ms(detected_ms), '%Y-%m-%d') ELSE {_PAGE_TITLE} END AS title FROM items""", "items"))
def x5(spark, sf):
    df = table(spark, sf, "items")
    # every fifth item has no page title, another fifth neither that nor a name in its URL
    page = F.when(F.col("media_id") % 5 >= 2, F.col("page_title"))
    url = F.when(F.col("media_id") % 5 == 1, F.regexp_extract("master_url", r"^([a-z]+://[^/]+/)", 1)).otherwise(F.col("master_url"))
    return df.select("media_id", text.derive_title(page, url, F.col("detected_ms")).alias("title"))


@query("x6_host_of", with_ctes(f"SELECT 'r' || CAST(request_id AS STRING) AS row_id, {sql_host('url')} AS host FROM requests UNION ALL SELECT 'p' || CAST(page_id AS STRING), {sql_host('url')} FROM pages", "requests"))
def x6(spark, sf):
    both = _requests(spark, sf).select(F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("row_id"), "url").unionByName(
        table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("row_id"), "url"))
    return both.select("row_id", urls.host_of(F.col("url")).alias("host"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT)"


@query("x7_hash_key", with_ctes(f"SELECT request_id, lpad(lower(to_base({_FNV}, 16)), 8, '0') AS hash16, lower(to_base({_FNV}, 36)) AS hash36 FROM requests", "requests"))
def x7(spark, sf):
    return _requests(spark, sf).select("request_id", text.hash_key(F.col("url")).alias("hash16"), text.hash_key36(F.col("url")).alias("hash36"))


@query("x8_resolve_url", with_ctes("""
SELECT manifest_id, CASE manifest_id % 6 WHEN 0 THEN regexp_replace(url, '[^/]*$', '') || 'deep/er/one.ts' WHEN 1 THEN regexp_extract(url, '^https://[^/]*', 0) || '/root/s.ts'
  WHEN 2 THEN 'https://other.example.com/x.ts' WHEN 3 THEN 'https://abs.example.com/y.ts?k=1'
  WHEN 4 THEN regexp_replace(url, '[^/]*/[^/]*$', '') || 'up/s.ts' ELSE url || '?q=1' END AS resolved FROM manifests""", "manifests"))
def x8(spark, sf):
    rel = F.element_at(F.array(*[F.lit(r) for r in ("deep/er/one.ts", "/root/s.ts", "//other.example.com/x.ts", "https://abs.example.com/y.ts?k=1", "../up/./s.ts", "?q=1")]),
                       (F.col("manifest_id") % 6 + 1).cast("int"))
    return table(spark, sf, "manifests").select("manifest_id", urls.resolve_url(F.col("url"), rel).alias("resolved"))


_PX = "CAST(coalesce(try_cast(split_part(resolution, 'x', 1) AS BIGINT) * try_cast(split_part(resolution, 'x', 2) AS BIGINT), 0) AS BIGINT)"
_H = "coalesce(try_cast(split_part(resolution, 'x', 2) AS BIGINT), 0)"
_LABEL = f"CASE WHEN resolution IS NULL THEN '' WHEN {_H} >= 4320 THEN '4320p' WHEN {_H} >= 2160 THEN '4K' WHEN {_H} >= 1440 THEN '2K' WHEN {_H} >= 1080 THEN '1080p' WHEN {_H} >= 720 THEN '720p' WHEN {_H} >= 480 THEN '480p' WHEN {_H} >= 360 THEN '360p' ELSE 'low' END"
_DASH = f"CASE WHEN resolution IS NULL THEN '' WHEN {_H} >= 2160 THEN '4K' WHEN {_H} >= 1080 THEN '1080p' WHEN {_H} >= 720 THEN '720p' WHEN {_H} >= 480 THEN '480p' ELSE {_H} || 'p' END"


@query("x9_resolution_of", with_ctes(f"SELECT media_id, {_PX} AS pixels, {_H} AS height, {_LABEL} AS quality_label, {_DASH} AS quality_label_dash FROM items", "items"))
def x9(spark, sf):
    r = media.resolution_of(F.col("resolution"))
    return table(spark, sf, "items").select("media_id", r["pixels"].alias("pixels"), r["height"].alias("height"), r["label"].alias("quality_label"),
                                            media.quality_label_dash(F.col("resolution")).alias("quality_label_dash"))


def sql_bytes(c: str) -> str:
    def part(p, unit):
        v = f"({c}::DOUBLE / {1024 ** p})"
        return f"CASE WHEN {v} >= 100 THEN CAST(floor({v} + 0.5)::BIGINT AS STRING) ELSE CAST(floor({v} * 10 + 0.5)::BIGINT // 10 AS STRING) || '.' || CAST(floor({v} * 10 + 0.5)::BIGINT % 10 AS STRING) END || ' {unit}'"
    return (f"CASE WHEN {c} IS NULL OR {c} < 0 THEN 'unknown' WHEN {c} < 1024 THEN CAST({c} AS STRING) || ' B' WHEN {c} < {1024 ** 2} THEN {part(1, 'KB')} "
            f"WHEN {c} < {1024 ** 3} THEN {part(2, 'MB')} WHEN {c} < {1024 ** 4} THEN {part(3, 'GB')} ELSE {part(4, 'TB')} END")


@query("x10_format_bytes", with_ctes(f"SELECT media_id AS id, 'item' AS source, {sql_bytes('size_bytes')} AS shown FROM items UNION ALL SELECT task_id, 'task', {sql_bytes('n')} FROM (SELECT task_id, total_bytes * (task_id % 2000) AS n FROM tasks) t", "items", "tasks"))
def x10(spark, sf):
    a = table(spark, sf, "items").select(F.col("media_id").alias("id"), F.lit("item").alias("source"), text.format_bytes(F.col("size_bytes")).alias("shown"))
    b = table(spark, sf, "tasks").select(F.col("task_id").alias("id"), F.lit("task").alias("source"), text.format_bytes(F.col("total_bytes") * (F.col("task_id") % 2000)).alias("shown"))
    return a.unionByName(b)


def sql_hms(sec: str) -> str:
    s = f"floor({sec} + 0.5)::BIGINT"
    return f"CASE WHEN {sec} IS NULL OR {sec} <= 0 THEN '--:--' ELSE printf('%02d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60) END"


@query("x11_format_duration", with_ctes(f"SELECT media_id, {sql_hms('duration_sec * 25')} AS shown FROM items", "items"))
def x11(spark, sf):
    return table(spark, sf, "items").select("media_id", text.format_duration(F.col("duration_sec") * 25).alias("shown"))


SQL_CLOCK = "printf('%02d:%02d:%02d', (ts_ms // 1000) % 86400 // 3600, (ts_ms // 1000) % 3600 // 60, (ts_ms // 1000) % 60)"


@query("x13_format_clock", with_ctes(f"SELECT log_id, {SQL_CLOCK} AS clock FROM logs", "logs"))
def x13(spark, sf):
    return table(spark, sf, "logs").select("log_id", text.format_clock(F.col("ts_ms")).alias("clock"))


def _name_meta():
    return {"title": F.col("page_title"), "site": urls.host_of(F.col("master_url")), "resolution": F.col("resolution"),
            "quality": media.resolution_of(F.col("resolution"))["label"], "bitrate": (F.col("media_id") * 10).cast("double"),
            "duration_sec": F.col("duration_sec"), "index": F.when(F.col("media_id") % 2 == 0, F.col("media_id") % 100), "ext": F.lit("mp4")}


_T = r"""trim(regexp_replace(regexp_replace(page_title, '[/\\:*?"<>|\x00-\x1f]', '', 'g'), '\s+', ' ', 'g'))"""
_D = "CASE WHEN duration_sec IS NULL OR duration_sec <= 0 THEN '' ELSE printf('%02dh%02dm%02ds', floor(duration_sec / 3600)::BIGINT, floor((duration_sec % 3600) / 60)::BIGINT, floor(duration_sec % 60 + 0.5)::BIGINT) END"


def sql_name(body: str) -> str:
    squeezed = rf"regexp_replace(regexp_replace({body}, '\s*[-_.]\s*[-_.][-_.\s]*', '-', 'g'), '^[-_.\s]+|[-_.\s]+$', '', 'g')"
    return f"left(coalesce(nullif({squeezed}, ''), regexp_replace({_T}, '\\s*[-_.]\\s*[-_.][-_.\\s]*', '-', 'g')), 150) || '.mp4'"


@query("x14_build_filename", with_ctes(f"""
SELECT media_id, {sql_name(f"{_T} || '-' || coalesce(resolution, '')")} AS plain, {sql_name("coalesce(resolution, '')")} AS resolution_only,
  {sql_name(f"CASE WHEN media_id % 2 = 0 THEN printf('%02d', media_id % 100) ELSE '' END || '-' || {_T} || '_' || {_D} || '.' || {sql_host('master_url')} || ' {{nope}} ' || CASE WHEN media_id = 0 THEN '' ELSE media_id * 10 || 'kbps' END")} AS full_name
FROM items""", "items"))
def x14(spark, sf):
    meta = _name_meta()
    return table(spark, sf, "items").select(
        "media_id", text.build_filename("{title}-{resolution}.flv", meta).alias("plain"), text.build_filename("{resolution}", meta).alias("resolution_only"),
        text.build_filename("{index}-{title}_{duration}.{site} {nope} {bitrate}", meta).alias("full_name"))


_TPL = "CASE doc_id % 4 WHEN 0 THEN concat('{{title}}-', text) WHEN 1 THEN concat('{{index}}', text) WHEN 2 THEN text ELSE ' ' END"


@query("x15_validate_template", f"""
SELECT doc_id, reason IS NULL AS ok, reason FROM (SELECT doc_id, CASE WHEN trim(t) = '' THEN 'empty' WHEN length(t) > 200 THEN 'too_long'
  WHEN NOT (contains(t, '{{title}}') OR contains(t, '{{index}}')) THEN 'not_unique' END AS reason
  FROM (SELECT doc_id, {_TPL.replace('{{', '{').replace('}}', '}')} AS t FROM documents) d) e""")
def x15(spark, sf):
    tpl = F.expr(_TPL.replace("{{", "{").replace("}}", "}"))
    return table(spark, sf, "documents").select("doc_id", text.validate_template(tpl).alias("v")).select("doc_id", "v.ok", "v.reason")


_EXTS = "mp4 m4v mov webm mkv ts m4s flv mp3 m4a AAC txt".split()
_MIMES = dict(zip([e.lower() for e in _EXTS], "video/mp4 video/mp4 video/quicktime video/webm video/x-matroska video/mp2t video/iso.segment video/x-flv audio/mpeg audio/mp4 audio/aac video/mp4".split()))


@query("x17_mime_for_filename", "SELECT p_partkey, CASE lower(split_part(name, '.', -1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MIMES.items()) +
       f" ELSE 'video/mp4' END AS mime FROM (SELECT p_partkey, p_name || '.' || {_EXTS}[p_partkey % 12 + 1] AS name FROM part) p")
def x17(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", media.mime_for_filename(F.concat("p_name", F.lit("."), ext)).alias("mime"))


# a MIME type for every fifth item each: a known audio type, one with parameters, an unknown audio type, a video type, none
_TOLD = "CASE media_id % 5 WHEN 0 THEN 'Audio/FLAC' WHEN 1 THEN 'audio/ogg; codecs=opus' WHEN 2 THEN 'audio/x-odd' WHEN 3 THEN 'video/webm' END"
_FILE = "CASE WHEN protocol = 'progressive' THEN lower(regexp_extract(split_part(master_url, '?', 1), '([^.]*)$', 1)) ELSE 'mp4' END"
_AUDIO = f"(media_type = 'audio' OR coalesce(lower({_TOLD}) LIKE 'audio/%', false) OR {_FILE} = 'm4a')"


@query("x18_output_profile", with_ctes(f"""
, t AS (SELECT media_id, {_AUDIO} AS audio, CASE WHEN {_FILE} = 'm4a' THEN 'm4a' ELSE CASE media_id % 5 WHEN 0 THEN 'flac' WHEN 1 THEN 'ogg' ELSE 'm4a' END END AS ext FROM items)
SELECT media_id, CASE WHEN audio THEN 'audio' ELSE 'video' END AS kind, CASE WHEN audio THEN ext ELSE 'mp4' END AS container, CASE WHEN audio THEN ext ELSE 'mp4' END AS ext,
  CASE WHEN audio THEN CASE ext WHEN 'm4a' THEN 'audio/mp4' ELSE 'audio/' || ext END ELSE 'video/mp4' END AS mime,
  CASE WHEN audio THEN 'mp3' ELSE 'mp4' END AS ext_mp3, CASE WHEN audio THEN 'audio/mpeg' ELSE 'video/mp4' END AS mime_mp3 FROM t""", "items"))
def x18(spark, sf):
    told = F.expr("CASE media_id % 5 WHEN 0 THEN 'Audio/FLAC' WHEN 1 THEN 'audio/ogg; codecs=opus' WHEN 2 THEN 'audio/x-odd' WHEN 3 THEN 'video/webm' END")
    args = (F.col("media_type"), F.col("protocol"), F.col("master_url"), told)
    df = table(spark, sf, "items").withColumns({"p": media.output_profile(*args), "q": media.output_profile(*args, audio_output="mp3")})
    return df.select("media_id", "p.kind", "p.container", "p.ext", "p.mime", F.col("q.ext").alias("ext_mp3"), F.col("q.mime").alias("mime_mp3"))


@query("x19_ext_from_url", with_ctes("""
SELECT request_id, lower(regexp_extract(CASE WHEN url LIKE '%://%' THEN regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]*', '') ELSE url END, '([^.]*)$', 1)) AS ext FROM requests""", "requests"))
def x19(spark, sf):
    return _requests(spark, sf).select("request_id", urls.ext_from_url(F.col("url")).alias("ext"))


def sql_masked(u: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(split_part({u}, '?', 1), '^[a-z]+://[^/]*', ''), '/'), lambda p: p <> '')[1:3]"
    return f"CASE WHEN {u} NOT LIKE '%://%' THEN '(invalid)' ELSE {sql_host(u)} || '/' || array_to_string({parts}, '/') || CASE WHEN len({parts}) > 0 THEN '/' ELSE '' END || '***' END"


@query("x20_sanitize_url", with_ctes(f"""
SELECT request_id, {sql_masked('url')} AS masked, CASE WHEN request_id % 3 = 0 THEN '/**' ELSE 'f' || request_id || '.mp4/**' END AS masked_path,
  CASE WHEN status_code = 206 THEN 'credentials' ELSE 'no_credentials' END AS note FROM requests""", "requests"))
def x20(spark, sf):
    name = F.concat(F.lit("f"), F.col("request_id").cast("string"), F.lit(".mp4"))
    path = F.when(F.col("request_id") % 3 == 0, name).otherwise(F.concat(F.lit("/home/user/"), name))
    return _requests(spark, sf).select("request_id", urls.sanitize_url(F.col("url")).alias("masked"), urls.sanitize_path(path).alias("masked_path"),
                                       urls.credentials_note(F.col("status_code") == 206).alias("note"))


@query("x21_parse_iso_duration", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 3) * 60.0 + doc_id % 50 + 0.5 WHEN 1 THEN (doc_id % 5) * 86400.0 + (doc_id % 20) * 3600 WHEN 2 THEN n_chars::DOUBLE END AS seconds FROM documents""")
def x21(spark, sf):
    d = lambda e: F.expr(e).cast("string")
    iso = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("PT"), d("doc_id % 3"), F.lit("M"), d("doc_id % 50"), F.lit(".5S"))).when(
        F.col("doc_id") % 4 == 1, F.concat(F.lit("P"), d("doc_id % 5"), F.lit("DT"), d("doc_id % 20"), F.lit("H"))).when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit("PT"), d("n_chars"), F.lit("S"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.parse_iso_duration(iso).alias("seconds"))


@query("x_sql_functions", with_ctes(f"""
SELECT request_id, {sql_norm('url')} AS dedup_key, {sql_bytes('content_length')} AS size_text,
  CASE WHEN url LIKE 'http%' THEN regexp_replace(split_part(url, '?', 1), '[^/]*$', '') || 'sub/next.ts' ELSE 'sub/next.ts' END AS next_url
FROM requests WHERE {sql_host('url')} LIKE 'cdn%'""", "requests"))
def x_sql(spark, sf):
    sql.register(spark)
    return spark.sql("""SELECT request_id, mt_normalize_url(url) AS dedup_key, mt_format_bytes(content_length) AS size_text, mt_resolve_url(url, './sub/next.ts') AS next_url
                        FROM {log} WHERE mt_host_of(url) LIKE 'cdn%'""", log=_requests(spark, sf))


@query("x22_substitute_template", "SELECT doc_id, lang || '/seg-' || printf('%05d', n_chars) || '-' || n_chars * 7 || '-' || doc_id || '.m4s' AS filled, lang || '/init-.mp4' AS init FROM documents")
def x22(spark, sf):
    ids = {"representation_id": F.col("lang"), "bandwidth": F.col("doc_id")}
    return table(spark, sf, "documents").select(
        "doc_id", text.substitute_template(F.lit("$RepresentationID$/seg-$Number%05d$-$Time$-$Bandwidth$.m4s"), number=F.col("n_chars"), time=F.col("n_chars") * 7, **ids).alias("filled"),
        text.substitute_template(F.lit("$RepresentationID$/init-$Time$.mp4"), **ids).alias("init"))


@query("x23_parse_track_url", with_ctes(f"""
SELECT request_id, {sql_host('url')} AS site_key, regexp_extract(split_part(url, '?', 1), {TRACK_RE}, 1) || '/' || regexp_extract(split_part(url, '?', 1), {TRACK_RE}, 2) AS group_id,
  CAST(regexp_extract(split_part(url, '?', 1), {TRACK_RE}, 4) AS BIGINT) AS codec_id, CASE WHEN url LIKE '%-302%' THEN 'audio' ELSE 'video' END AS track_type,
  'bcdn.example|' || group_id || '|' || codec_id AS key FROM requests WHERE regexp_matches(split_part(url, '?', 1), {TRACK_RE})""", "requests"))
def x23(spark, sf):
    return _requests(spark, sf).select("request_id", urls.parse_track_url(F.col("url")).alias("t")).filter("t IS NOT NULL").select("request_id", "t.*")


# ---- listed items: title, state and status from the item table ----

LISTED = f"""listed AS (SELECT *, {_PAGE_TITLE} AS title,
  CASE WHEN is_failed THEN 'parse_failed' WHEN is_parsing THEN 'parsing' WHEN encryption = 'drm' THEN 'protected' WHEN live THEN 'unsupported'
       WHEN encryption = 'aes128' THEN 'ready_encrypted' WHEN encryption = 'sampleaes' THEN 'protected' ELSE 'ready' END AS status,
  CASE WHEN encryption = 'drm' THEN 'drm' WHEN live THEN 'live' WHEN encryption = 'sampleaes' THEN 'sampleaes' END AS blocked_reason,
  NOT (encryption IN ('drm', 'sampleaes') OR live) AS downloadable FROM items)"""


def listed_items(spark, sf) -> DataFrame:
    df = table(spark, sf, "items").withColumn("_s", media.derive_downloadable(F.col("encryption"), F.col("live")))
    status = F.when(F.col("is_failed"), F.lit("parse_failed")).when(F.col("is_parsing"), F.lit("parsing")).otherwise(F.col("_s.status"))
    title = text.derive_title(F.col("page_title"), F.col("master_url"), F.col("detected_ms"))
    return df.withColumns({"title": title, "status": status, "downloadable": F.col("_s.downloadable"), "blocked_reason": F.col("_s.blocked_reason")}).drop("_s")


@query("x24_derive_downloadable", with_ctes(f", {LISTED} SELECT media_id, status, downloadable, blocked_reason FROM listed", "items"))
def x24(spark, sf):
    return listed_items(spark, sf).select("media_id", "status", "downloadable", "blocked_reason")


_SESSION = """counts AS (SELECT tab_id, count(*) AS n, count(*) FILTER (WHERE downloadable AND status NOT IN ('parsing', 'hint')) AS d,
  count(*) FILTER (WHERE NOT downloadable) AS b, count(*) FILTER (WHERE status = 'parsing') AS p FROM listed GROUP BY tab_id),
active AS (SELECT tab_id, count(*) AS a FROM tasks WHERE stage IN ('downloading', 'decrypting', 'merging', 'transcoding', 'queued') GROUP BY tab_id),
every_tab AS (SELECT tab_id, coalesce(n, 0) AS n, coalesce(d, 0) AS d, coalesce(b, 0) AS b, coalesce(p, 0) AS p, coalesce(a, 0) AS a FROM counts FULL JOIN active USING (tab_id))"""


@query("x25_session_status", with_ctes(f""", {LISTED}, {_SESSION}
SELECT tab_id, CASE WHEN n = 0 THEN CASE WHEN a > 0 THEN 'ring' ELSE 'gray' END WHEN b = n THEN 'locked' WHEN d > 0 OR p > 0 THEN CASE WHEN a > 0 THEN 'ring' ELSE 'idle' END ELSE 'gray' END AS icon,
  CASE WHEN n > 0 AND b < n AND d > 0 THEN CASE WHEN d > 9 THEN '9+' ELSE CAST(d AS STRING) END END AS badge FROM every_tab""", "items", "tasks"))
def x25(spark, sf):
    counts = item_ops.session_counts(listed_items(spark, sf), by=["tab_id"])
    active = table(spark, sf, "tasks").filter(F.col("stage").isin(media.ACTIVE_STAGES)).groupBy("tab_id").agg(F.count(F.lit(1)).alias("active"))
    df = counts.join(active, "tab_id", "full_outer").fillna(0)
    state = media.session_status(F.col("item_count"), F.col("downloadable_count"), F.col("protected_count"), F.col("parsing_count"), F.col("active"))
    return df.select("tab_id", state.alias("s")).select("tab_id", "s.icon", "s.badge")


@query("x26_empty_cause", with_ctes(f""", {LISTED}, {STAGED_HTTP}, r AS (SELECT tab_id, count(*) AS f FROM shttp WHERE size > 4000000 GROUP BY tab_id),
c AS (SELECT tab_id, protocol, count(*) AS n, count(*) FILTER (WHERE NOT downloadable) AS b FROM listed GROUP BY tab_id, protocol)
SELECT tab_id, protocol, CASE WHEN b > 0 AND b = n THEN 'protected' WHEN coalesce(f, 0) > 0 THEN 'filtered' ELSE 'none' END AS cause FROM c LEFT JOIN r USING (tab_id)""", "items", "requests"))
def x26(spark, sf):
    counts = item_ops.session_counts(listed_items(spark, sf), by=["tab_id", "protocol"])
    dropped = _requests(spark, sf).filter("kind = 'http' AND tab_id >= 0 AND status_code BETWEEN 200 AND 399 AND method <> 'OPTIONS' AND content_length > 4000000")
    joined = counts.join(dropped.groupBy("tab_id").agg(F.count(F.lit(1)).alias("f")), "tab_id", "left").fillna(0, ["f"])
    return joined.select("tab_id", "protocol", media.empty_cause(F.col("item_count"), F.col("protected_count"), F.col("f")).alias("cause"))


@query("x27_item_tags", with_ctes(f""", {LISTED}
SELECT media_id, array_to_string(list_filter([
  CASE WHEN {_LABEL} <> '' THEN {_LABEL} || CASE WHEN media_id % 4 > 1 THEN ' · ' || media_id % 4 || ' variants' ELSE '' END END,
  CASE WHEN protocol = 'dash' AND track_count > 1 THEN 'dash_two_tracks' END, CASE WHEN protocol = 'dash' AND track_count = 1 THEN 'video_only' END,
  CASE WHEN encryption = 'aes128' THEN 'AES-128' END, CASE WHEN blocked_reason = 'drm' THEN 'protected' END, CASE WHEN blocked_reason = 'sampleaes' THEN 'sample_aes' END,
  CASE WHEN blocked_reason = 'live' THEN 'live' END, CASE WHEN status = 'parse_failed' THEN 'parse_failed' END, CASE WHEN status = 'parsing' THEN 'parsing' END
  ], lambda t: t IS NOT NULL), '|') AS tags,
  concat_ws(' · ', resolution, CASE WHEN size_bytes IS NOT NULL THEN {sql_bytes('size_bytes')} END, upper(split_part(split_part(master_url, '?', 1), '.', -1))) AS spec
FROM listed""", "items"))
def x27(spark, sf):
    tags = media.item_tags(resolution=F.col("resolution"), variant_count=F.col("media_id") % 4, protocol=F.col("protocol"), track_count=F.col("track_count"),
                           encryption=F.col("encryption"), blocked_reason=F.col("blocked_reason"), status=F.col("status"))
    return listed_items(spark, sf).select("media_id", F.array_join(tags, "|").alias("tags"),
                                          media.spec_text(F.col("resolution"), F.col("size_bytes"), F.col("master_url")).alias("spec"))


@query("x28_task_progress", with_ctes("""
, t AS (SELECT *, task_id % 12 AS total, task_id % 7 AS done, total_bytes // (task_id % 5 + 1) AS got, (task_id % 600) / 2.0::DOUBLE AS el FROM tasks)
SELECT task_id, CASE WHEN stage = 'merging' THEN NULL WHEN total > 0 THEN round(least(100.0, done::DOUBLE / total * 100), 6) WHEN total_bytes > 0 AND got > 0 THEN round(least(100.0, got::DOUBLE / total_bytes * 100), 6) WHEN stage = 'done' THEN 100.0 ELSE 0.0 END AS pct,
  CASE stage WHEN 'downloading' THEN 'fetching' WHEN 'merging' THEN 'joining' ELSE stage END AS label,
  CASE WHEN el > 1 AND got > 0 THEN round(got::DOUBLE / el, 3) ELSE 0.0 END AS speed_bps,
  CASE WHEN el > 1 AND got > 0 AND total_bytes > 0 THEN round(greatest(0.0, (total_bytes - got) / greatest(got::DOUBLE / el, 1.0)), 6) END AS eta_sec FROM t""", "tasks"))
def x28(spark, sf):
    p = media.task_progress(stage=F.col("stage"), completed=F.col("task_id") % 7, total_segments=F.col("task_id") % 12,
                            bytes_done=F.expr("total_bytes div (task_id % 5 + 1)"), total_bytes=F.col("total_bytes"), elapsed_sec=(F.col("task_id") % 600) / F.lit(2.0))
    return table(spark, sf, "tasks").select("task_id", p.alias("p")).select(
        "task_id", F.round("p.pct", 6).alias("pct"), "p.label", F.round("p.speed_bps", 3).alias("speed_bps"), F.round("p.eta_sec", 6).alias("eta_sec"))


_MERGE_ERRORS = ["unsupported_codec:HEVC", "merge_validation_failed:no_ftyp", "boom"]


@query("x29_error_text", with_ctes(f"""
SELECT shown, count(*) AS n FROM (SELECT CASE WHEN status_code IN (401, 403) THEN 'credential_expired' WHEN status_code = 404 THEN 'not_found'
  WHEN status_code IN (429, 503) THEN 'rate_limited' WHEN segment_index % 3 = 0 THEN 'timed_out' WHEN segment_index % 3 = 1 THEN 'out_of_memory' ELSE 'unknown_error' END AS shown
  FROM fetch_attempts WHERE status_code <> 200) e GROUP BY shown
UNION ALL SELECT code || ' ' || t, count(*) FROM (SELECT CASE task_id % 3 WHEN 0 THEN 'unsupported_codec' WHEN 1 THEN 'merge_validation' ELSE 'merge_failed' END AS code,
  CASE task_id % 3 WHEN 0 THEN 'codec: HEVC' WHEN 1 THEN 'validation: merge_validation_failed:no_ftyp' ELSE 'merge: boom' END AS t FROM tasks) m GROUP BY ALL""", "fetch_attempts", "tasks"))
def x29(spark, sf):
    message = F.element_at(F.array(F.lit("timeout"), F.lit("out of memory"), F.lit("")), (F.col("segment_index") % 3 + 1).cast("int"))
    a = table(spark, sf, "fetch_attempts").filter("status_code <> 200").select(media.error_text(F.col("status_code"), message).alias("shown"))
    m = media.merge_error(F.element_at(F.array(*[F.lit(e) for e in _MERGE_ERRORS]), (F.col("task_id") % 3 + 1).cast("int")))
    b = table(spark, sf, "tasks").select(F.concat(m["code"], F.lit(" "), m["text"]).alias("shown"))
    return a.unionByName(b).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


@query("x30_aes_iv", with_ctes("""
SELECT task_id, segment_index, CASE WHEN segment_index % 2 = 0 THEN '00112233445566778899aabbccddeeff' ELSE printf('%032x', segment_index) END AS iv FROM segment_store""", "segment_store"))
def x30(spark, sf):
    iv = text.aes_iv(F.when(F.col("segment_index") % 2 == 0, F.lit("00112233445566778899aabbccddeeff")), F.col("segment_index"))
    return table(spark, sf, "segment_store").select("task_id", "segment_index", F.lower(F.hex(iv)).alias("iv"))


@query("x31_size_estimate", with_ctes("""
SELECT task_id, CAST(floor(avg(bytes) * (count(*) + task_id % 3) + 0.5) AS BIGINT) AS estimate, coalesce(abs((sum(bytes) - estimate) / nullif(estimate, 0)) > 0.3, false) AS recalibrate
FROM segment_store GROUP BY task_id""", "segment_store"))
def x31(spark, sf):
    per = table(spark, sf, "segment_store").groupBy("task_id").agg(F.avg("bytes").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("actual"))
    df = per.withColumn("estimate", media.size_estimate(F.col("mean"), F.col("n") + F.col("task_id") % 3))
    return df.select("task_id", "estimate", media.needs_recalibration(F.col("estimate"), F.col("actual")).alias("recalibrate"))


_BRANDS = ["isom", "M4A ", "dash", "qt  "]


@query("x33_container_census", f"""
SELECT is_mp4, major_brand, family, count(*) AS files, CAST(sum(CASE WHEN is_mp4 THEN 16 ELSE 0 END + strlen(text)) AS BIGINT) AS bytes FROM (
  SELECT text, doc_id % 5 <> 4 AS is_mp4, CASE WHEN doc_id % 5 <> 4 THEN {_BRANDS}[doc_id % 5 + 1] END AS major_brand,
    CASE doc_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'other' END AS family FROM documents) d GROUP BY ALL""")
def x33(spark, sf):
    brand = F.element_at(F.array(*[F.lit(b) for b in _BRANDS]), (F.col("doc_id") % 5 + 1).cast("int"))
    head = F.concat(F.lit(b"\x00\x00\x00\x10"), F.encode(F.concat(F.lit("ftyp"), brand), "UTF-8"), F.lit(b"\x00\x00\x02\x00"))
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 5 == 4, body).otherwise(F.concat(head, body))
    return segments.container_census(table(spark, sf, "documents").select(content.alias("content")))


# ---- item lists ----

@query("f7_filter_type", with_ctes(f", {LISTED} SELECT media_id, media_type FROM listed WHERE media_type = 'audio'", "items"))
def f7(spark, sf):
    return item_ops.filter_type(listed_items(spark, sf), "audio").select("media_id", "media_type")


@query("f8_search_items", with_ctes(f""", {LISTED} SELECT media_id, title FROM listed WHERE contains(lower(title), '05') OR (duration_sec IS NOT NULL AND contains({sql_hms('duration_sec')}, '05'))
  OR (size_bytes IS NOT NULL AND contains(lower({sql_bytes('size_bytes')}), '05'))""", "items"))
def f8(spark, sf):
    return item_ops.search_items(listed_items(spark, sf), " 05 ").select("media_id", "title")


@query("f9_smart_search", with_ctes(f""", {LISTED}
SELECT 'size' AS how, media_id FROM listed WHERE size_bytes >= 300 * 1048576.0 AND size_bytes < 301 * 1048576.0
UNION ALL SELECT 'duration', media_id FROM listed WHERE abs(duration_sec - 7530) * 10 <= 7530 UNION ALL SELECT 'title', media_id FROM listed WHERE contains(lower(title), 'machinery')""", "items"))
def f9(spark, sf):
    listed = listed_items(spark, sf)
    parts = [item_ops.smart_search(listed, q).select(F.lit(how).alias("how"), "media_id") for how, q in (("size", "300"), ("duration", "125:30"), ("title", "Machinery"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f10_downloadable_only", with_ctes(f", {LISTED} SELECT media_id FROM listed WHERE downloadable", "items"))
def f10(spark, sf):
    return item_ops.downloadable_only(listed_items(spark, sf)).select("media_id")


@query("f10_explain_blocked", with_ctes(f""", {LISTED} SELECT media_id, CASE WHEN blocked_reason = 'live' THEN 'live' ELSE 'protected' END AS why
FROM listed WHERE NOT downloadable""", "items"))
def f10b(spark, sf):
    return item_ops.explain_blocked(listed_items(spark, sf)).select("media_id", "why")


@query("t3_first_seen_order", with_ctes(f", {LISTED} SELECT tab_id, detected_ms, media_id FROM listed ORDER BY 1, 2, 3", "items"))
def t3(spark, sf):
    return item_ops.first_seen_order(listed_items(spark, sf), session=["tab_id"], detected="detected_ms", item="media_id").select("tab_id", "detected_ms", "media_id")


@query("t4_sort_items", with_ctes(f", {LISTED} SELECT media_id, resolution FROM listed ORDER BY nullif({_PX}, 0) DESC NULLS LAST, media_id", "items"))
def t4(spark, sf):
    return item_ops.sort_items(listed_items(spark, sf), "resolution", True, tie="media_id").select("media_id", "resolution")


@query("t7_cap_list", with_ctes(f", {LISTED} SELECT tab_id, media_id, row_number() OVER (PARTITION BY tab_id ORDER BY detected_ms, media_id) AS rank, rank > 20 AS folded FROM listed", "items"))
def t7(spark, sf):
    return item_ops.cap_list(listed_items(spark, sf), 20, session=["tab_id"], order=["detected_ms", "media_id"], width=3_600_000).select("tab_id", "media_id", "rank", "folded")


@query("w11_batch_index", with_ctes(f""", {LISTED} SELECT tab_id, media_id, row_number() OVER (PARTITION BY tab_id ORDER BY detected_ms, media_id) AS batch_index FROM listed WHERE downloadable""", "items"))
def w11(spark, sf):
    return item_ops.batch_index(listed_items(spark, sf), batch=["tab_id"], order=["detected_ms", "media_id"], width=3_600_000).select("tab_id", "media_id", "batch_index")


@query("n11_freeze_snapshot", with_ctes(f", {LISTED} SELECT media_id, tab_id, title, status, size_bytes, duration_sec FROM listed", "items"))
def n11(spark, sf):
    listed = listed_items(spark, sf).select("media_id", "tab_id", "title", "status", "size_bytes", "duration_sec")
    frozen = item_ops.freeze_snapshot(listed, key=["media_id"])
    return item_ops.thaw_snapshot(frozen, "tab_id bigint, title string, status string, size_bytes bigint, duration_sec double", key=["media_id"])


# ---- logs and metrics ----

@query("f11_filter_logs", with_ctes("SELECT log_id, level FROM logs WHERE level IN ('WARN', 'ERROR') AND contains(msg || coalesce(detail, ''), 'token=1')", "logs"))
def f11(spark, sf):
    return log_ops.filter_logs(table(spark, sf, "logs"), "WARN", "token=1").select("log_id", "level")


@query("f11_filter_logs_all", with_ctes("SELECT log_id, level FROM logs WHERE contains(msg, 'signup') OR contains(detail, 'signup')", "logs"))
def f11_all(spark, sf):
    return log_ops.filter_logs(table(spark, sf, "logs"), "ALL", "signup").select("log_id", "level")


@query("t6_latest_logs", with_ctes("SELECT log_id, ts_ms, level FROM logs ORDER BY ts_ms DESC, log_id DESC LIMIT 1000", "logs"))
def t6(spark, sf):
    return log_ops.latest_logs(table(spark, sf, "logs")).select("log_id", "ts_ms", "level")


@query("s10_export_logs", with_ctes(f"SELECT log_id, {SQL_CLOCK} || ' [' || level || '] ' || module || ': ' || msg || CASE WHEN detail IS NULL THEN '' ELSE ' (' || {sql_masked('detail')} || ')' END AS line FROM logs", "logs"))
def s10(spark, sf):
    return table(spark, sf, "logs").select("log_id", log_ops.log_line().alias("line"))


@query("a14_local_metrics", with_ctes("""
SELECT protocol, tab_id, count(*) AS tasks, count(*) FILTER (WHERE stage = 'done') AS done, count(*) FILTER (WHERE stage = 'failed') AS failed,
  round(count(*) FILTER (WHERE stage = 'done') / nullif(count(*) FILTER (WHERE stage IN ('done', 'failed')), 0), 6) AS success_rate FROM tasks GROUP BY protocol, tab_id""", "tasks"))
def a14(spark, sf):
    return log_ops.local_metrics(table(spark, sf, "tasks"), ["protocol", "tab_id"])
