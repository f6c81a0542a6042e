"""Queries over stored HLS and DASH manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.operators import analysis, dash, hls, items
from mediatally.plans.registry import query
from mediatally.plans.tables import table, with_ctes


def _hls(spark, sf) -> DataFrame:
    return table(spark, sf, "manifests")


LINES = """lines AS (SELECT manifest_id, url, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM manifests),
kinds AS (SELECT manifest_id, any_value(url) AS url, CASE WHEN NOT bool_or(pos = 0 AND line LIKE '#EXTM3U%') THEN 'error' WHEN bool_or(line LIKE '#EXT-X-STREAM-INF%') THEN 'master' ELSE 'media' END AS kind,
  coalesce(max(CASE WHEN line LIKE '#EXT-X-MEDIA-SEQUENCE:%' THEN split_part(line, ':', 2)::BIGINT END), 0) AS seq,
  coalesce(max(CASE WHEN line LIKE '#EXT-X-TARGETDURATION:%' THEN split_part(line, ':', 2)::DOUBLE END), 0) AS target,
  NOT bool_or(line LIKE '#EXT-X-ENDLIST%') AS live, arg_max(line, pos) FILTER (WHERE line LIKE '#EXT-X-KEY:%') AS key_line FROM lines GROUP BY manifest_id),
uris AS (SELECT l.*, k.kind, k.seq, row_number() OVER (PARTITION BY l.manifest_id ORDER BY pos) - 1 AS ord, lag(pos, 1, -1) OVER (PARTITION BY l.manifest_id ORDER BY pos) AS prev_pos
  FROM lines l JOIN kinds k USING (manifest_id) WHERE line <> '' AND line NOT LIKE '#%' AND kind <> 'error'),
segs AS (SELECT u.manifest_id, u.ord AS pos, u.seq + u.ord AS segment_index, regexp_replace(u.url, '[^/]*$', '') || u.line AS segment_url,
  coalesce((SELECT arg_max(split_part(split_part(e.line, ':', 2), ',', 1)::DOUBLE, e.pos) FROM lines e WHERE e.manifest_id = u.manifest_id AND e.line LIKE '#EXTINF:%' AND e.pos > u.prev_pos AND e.pos < u.pos), 0) AS duration_sec,
  (SELECT arg_max(split_part(e.line, ':', 2), e.pos) FROM lines e WHERE e.manifest_id = u.manifest_id AND e.line LIKE '#EXT-X-BYTERANGE:%' AND e.pos > u.prev_pos AND e.pos < u.pos) AS byte_range
  FROM uris u WHERE u.kind = 'media')"""

_VARS = LINES + """, infs AS (SELECT manifest_id, url, pos, line, row_number() OVER (PARTITION BY manifest_id ORDER BY pos) - 1 AS ord,
  nullif(regexp_extract(line, 'RESOLUTION=([0-9x]+)', 1), '') AS resolution, nullif(regexp_extract(line, 'BANDWIDTH=([0-9]+)', 1), '')::BIGINT AS bandwidth,
  nullif(regexp_extract(line, 'CODECS="([^"]*)"', 1), '') AS codecs FROM lines WHERE line LIKE '#EXT-X-STREAM-INF:%'),
bound AS (SELECT i.*, (SELECT arg_min(n.line, n.pos) FROM lines n WHERE n.manifest_id = i.manifest_id AND n.pos > i.pos AND n.line <> '' AND n.line NOT LIKE '#%') AS uri FROM infs i),
sized AS (SELECT *, split_part(resolution, 'x', 1)::BIGINT * split_part(resolution, 'x', 2)::BIGINT AS pixels, split_part(resolution, 'x', 2)::BIGINT AS h FROM bound),
variants AS (SELECT manifest_id, CAST(row_number() OVER (PARTITION BY manifest_id ORDER BY pixels DESC, bandwidth DESC, ord) AS INTEGER) AS rank, resolution || '-' || ord AS variant_id, resolution,
  CASE WHEN h >= 1440 THEN '2K' ELSE '360p' END AS quality_label, pixels, bandwidth, codecs, regexp_replace(url, '[^/]*$', '') || uri AS playlist_url FROM sized)"""


@query("s4_read_lines", with_ctes(f", {LINES} SELECT manifest_id, CAST(pos AS INTEGER) AS pos, line FROM lines", "manifests"))
def s4(spark, sf):
    return hls.read_lines(_hls(spark, sf)).select("manifest_id", "pos", "line")


@query("n1_hls_attributes", with_ctes(f""", {LINES}
SELECT manifest_id, pos::INTEGER AS pos, nullif(regexp_extract(line, 'BANDWIDTH=([0-9]+)', 1), '') AS bandwidth, nullif(regexp_extract(line, 'CODECS="([^"]*)"', 1), '') AS codecs,
  nullif(regexp_extract(line, 'METHOD=([A-Z0-9-]+)', 1), '') AS method, CASE WHEN line LIKE '#EXT-X-KEY%' THEN regexp_extract(line, 'URI="([^"]*)"', 1) END AS uri
FROM lines WHERE line LIKE '#EXT-X-STREAM-INF:%' OR line LIKE '#EXT-X-KEY:%'""", "manifests"))
def n1(spark, sf):
    lines = hls.read_lines(_hls(spark, sf)).filter("line LIKE '#EXT-X-STREAM-INF:%' OR line LIKE '#EXT-X-KEY:%'")
    lines = lines.withColumn("a", hls.attributes(F.regexp_replace("line", r"^[^:]*:", "")))
    return lines.select("manifest_id", "pos", *[F.try_element_at("a", F.lit(k)).alias(k.lower()) for k in ("BANDWIDTH", "CODECS", "METHOD", "URI")])


@query("w4_next_uri", with_ctes(f""", {LINES}
SELECT manifest_id, CAST(pos AS INTEGER) AS pos, first_value(CASE WHEN line <> '' AND line NOT LIKE '#%' THEN line END IGNORE NULLS) OVER (PARTITION BY manifest_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_uri FROM lines""", "manifests"))
def w4(spark, sf):
    return hls.next_uri(hls.read_lines(_hls(spark, sf))).select("manifest_id", "pos", "next_uri")


@query("n2_hls_variants", with_ctes(f""", {_VARS} SELECT *, NULL::STRING AS parse_error FROM variants
UNION ALL SELECT manifest_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing #EXTM3U' FROM kinds WHERE kind = 'error'""", "manifests"))
def n2(spark, sf):
    return hls.hls_variants(_hls(spark, sf))


@query("t1_sort_variants", with_ctes(f", {_VARS} SELECT manifest_id, rank, pixels, bandwidth FROM variants", "manifests"))
def t1(spark, sf):
    return hls.hls_variants(_hls(spark, sf)).filter("parse_error IS NULL").select("manifest_id", "rank", "pixels", "bandwidth")


@query("t2_default_variant", with_ctes(f", {_VARS} SELECT manifest_id, variant_id, quality_label, playlist_url FROM variants WHERE rank = 1", "manifests"))
def t2(spark, sf):
    return hls.default_variant(_hls(spark, sf)).select("manifest_id", "variant_id", "quality_label", "playlist_url")


@query("n3_hls_segments", with_ctes(f""", {LINES} SELECT manifest_id, segment_index, segment_url, duration_sec, split_part(byte_range, '@', 1)::BIGINT AS range_length,
  coalesce(nullif(split_part(byte_range, '@', 2), ''), CASE WHEN byte_range IS NOT NULL THEN '0' END)::BIGINT AS range_offset, NULL::STRING AS parse_error FROM segs
UNION ALL SELECT manifest_id, NULL, NULL, NULL, NULL, NULL, 'missing #EXTM3U' FROM kinds WHERE kind = 'error'""", "manifests"))
def n3(spark, sf):
    return hls.hls_segments(_hls(spark, sf)).select("manifest_id", "segment_index", "segment_url", "duration_sec", "range_length", "range_offset", "parse_error")


@query("w3_segment_index", with_ctes(f", {LINES} SELECT manifest_id, CAST(pos AS INTEGER) AS pos, segment_index FROM segs", "manifests"))
def w3(spark, sf):
    return hls.hls_segments(_hls(spark, sf)).filter("parse_error IS NULL").select("manifest_id", "pos", "segment_index")


_ENC = "CASE WHEN key_line LIKE '%METHOD=AES-128%' THEN 'aes128' WHEN key_line LIKE '%METHOD=SAMPLE-AES%' THEN 'sampleaes' ELSE 'none' END"


@query("n4_hls_encryption", with_ctes(f""", {LINES} SELECT manifest_id, {_ENC} AS method, CASE WHEN key_line LIKE '%AES-128%' THEN regexp_extract(key_line, 'URI="([^"]*)"', 1) END AS key_url,
  CASE WHEN key_line LIKE '%AES-128%' THEN regexp_extract(key_line, 'IV=0x([0-9a-f]*)', 1) END AS iv_hex FROM kinds WHERE kind = 'media'""", "manifests"))
def n4(spark, sf):
    return hls.hls_encryption(_hls(spark, sf))


@query("a3_playlist_totals", with_ctes(f""", {LINES} SELECT manifest_id, count(*) AS segment_count, sum(duration_sec) AS duration_sec, sum(duration_sec) / count(*) AS avg_segment_sec,
  any_value(target) AS target_sec, any_value(k.seq) AS media_sequence, any_value(live) AS live, any_value({_ENC}) AS encryption FROM segs JOIN kinds k USING (manifest_id) GROUP BY manifest_id""", "manifests"))
def a3(spark, sf):
    return hls.playlist_totals(_hls(spark, sf))


@query("x24_hls_items", with_ctes(f""", {LINES} SELECT manifest_id, CASE WHEN kind = 'error' THEN 'parse_failed' WHEN kind = 'master' THEN 'ready' WHEN live THEN 'unsupported' WHEN {_ENC} = 'aes128' THEN 'ready_encrypted'
  WHEN {_ENC} = 'sampleaes' THEN 'protected' ELSE 'ready' END AS status, kind <> 'media' OR NOT (live OR {_ENC} = 'sampleaes') AS downloadable,
  CASE WHEN kind = 'media' THEN CASE WHEN live THEN 'live' WHEN {_ENC} = 'sampleaes' THEN 'sampleaes' END END AS blocked_reason FROM kinds""", "manifests"))
def x24_hls(spark, sf):
    return hls.hls_items(_hls(spark, sf))


# playlists of the masters' variants: of three manifests in a row the first is a master, the others are its variants' playlists
_VARIANT_URL = ("concat('https://edge', CAST((manifest_id - manifest_id % 3) % 5 AS STRING), '.media.test/hls/', CAST(manifest_id - manifest_id % 3 AS STRING), "
                "CASE WHEN manifest_id % 3 = 1 THEN '/small/list.m3u8' ELSE '/large/list.m3u8' END)")


def _playlists(spark, sf) -> DataFrame:
    return _hls(spark, sf).withColumn("url", F.when(F.col("manifest_id") % 3 == 0, F.col("url")).otherwise(F.expr(_VARIANT_URL)))


_PROBED = _VARS + f""", totals AS (SELECT manifest_id, sum(duration_sec) AS duration_sec, count(*) AS segment_count, any_value({_ENC}) AS encryption, any_value(live) AS live
  FROM segs JOIN kinds k USING (manifest_id) GROUP BY manifest_id),
probed AS (SELECT v.manifest_id, v.rank, v.variant_id, t.duration_sec, t.segment_count, t.encryption, t.live FROM variants v
  LEFT JOIN totals t ON t.manifest_id = v.manifest_id + CASE WHEN v.playlist_url LIKE '%/small/%' THEN 1 ELSE 2 END)"""


@query("a12_variant_probe", with_ctes(f", {_PROBED} SELECT * FROM probed", "manifests"))
def a12_probe(spark, sf):
    variants = hls.hls_variants(_hls(spark, sf)).filter("parse_error IS NULL")
    return analysis.probe_variants(variants, _playlists(spark, sf)).select(
        "manifest_id", "rank", "variant_id", "duration_sec", "segment_count", "encryption", "live")


@query("x24_items_with_manifests", with_ctes(f""", {_PROBED}, worst AS (
  SELECT manifest_id, count(*) AS n, max(CASE encryption WHEN 'sampleaes' THEN 2 WHEN 'aes128' THEN 1 ELSE 0 END) AS severity FROM probed GROUP BY manifest_id),
own AS (SELECT k.manifest_id, k.kind, k.live, {_ENC} AS enc, coalesce(w.severity, 0) AS severity, w.n FROM kinds k LEFT JOIN worst w USING (manifest_id)),
total AS (SELECT manifest_id, sum(duration_sec) AS duration_sec FROM segs GROUP BY manifest_id)
SELECT o.manifest_id, CASE WHEN kind = 'error' THEN 'parse_failed' WHEN kind = 'media' AND o.live THEN 'unsupported'
    WHEN kind = 'media' AND enc = 'sampleaes' OR kind = 'master' AND severity = 2 THEN 'protected'
    WHEN kind = 'media' AND enc = 'aes128' OR kind = 'master' AND severity = 1 THEN 'ready_encrypted' ELSE 'ready' END AS status,
  NOT (kind = 'media' AND (o.live OR enc = 'sampleaes') OR kind = 'master' AND severity = 2) AS downloadable,
  CASE WHEN kind = 'media' AND o.live THEN 'live' WHEN kind = 'media' AND enc = 'sampleaes' OR kind = 'master' AND severity = 2 THEN 'sampleaes' END AS blocked_reason,
  CASE WHEN kind = 'media' THEN enc WHEN kind = 'master' THEN CASE severity WHEN 2 THEN 'sampleaes' WHEN 1 THEN 'aes128' ELSE 'none' END ELSE 'none' END AS encryption,
  CASE WHEN kind = 'media' THEN t.duration_sec END AS duration_sec,
  CASE kind WHEN 'media' THEN 1 WHEN 'master' THEN coalesce(n, 0) ELSE 0 END::BIGINT AS variant_count
FROM own o LEFT JOIN total t USING (manifest_id)""", "manifests"))
def x24_items(spark, sf):
    stored = _hls(spark, sf)
    hints = stored.select(
        F.col("manifest_id").alias("request_id"), (F.col("manifest_id") % 50).alias("tab_id"), (F.col("manifest_id") * 1000).alias("ts_ms"),
        "url", F.lit("application/vnd.apple.mpegurl").alias("mime"), F.lit(None).cast("bigint").alias("size"))
    merged = items.merge_items(hints, session=["tab_id"])
    out = analysis.apply_manifests(merged, stored, _playlists(spark, sf))
    number = F.regexp_extract("master_url", r"/hls/(\d+)/", 1).cast("bigint")
    return out.select(number.alias("manifest_id"), "status", "downloadable", "blocked_reason", "encryption", "duration_sec", "variant_count")


@query("w14_cumulative_start", with_ctes(f", {LINES} SELECT manifest_id, CAST(pos AS INTEGER) AS pos, coalesce(sum(duration_sec) OVER (PARTITION BY manifest_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sec FROM segs", "manifests"))
def w14(spark, sf):
    segments = hls.hls_segments(_hls(spark, sf)).filter("parse_error IS NULL")
    return hls.cumulative_start(segments).select("manifest_id", "pos", "start_sec")


@query("a12_encryption_rollup", with_ctes(f""", {_PROBED}
SELECT manifest_id, CASE max(CASE encryption WHEN 'sampleaes' THEN 2 WHEN 'aes128' THEN 1 ELSE 0 END) WHEN 2 THEN 'sampleaes' WHEN 1 THEN 'aes128' ELSE 'none' END AS encryption, bool_or(live) AS live,
  CASE WHEN bool_or(live) THEN 'unsupported' WHEN bool_or(encryption = 'sampleaes') THEN 'protected' WHEN bool_or(encryption = 'aes128') THEN 'ready_encrypted' ELSE 'ready' END AS status,
  NOT bool_or(live OR encryption = 'sampleaes') AS downloadable, CASE WHEN bool_or(live) THEN 'live' WHEN bool_or(encryption = 'sampleaes') THEN 'sampleaes' END AS blocked_reason
FROM probed WHERE encryption IS NOT NULL GROUP BY manifest_id""", "manifests"))
def a12(spark, sf):
    variants = hls.hls_variants(_hls(spark, sf)).filter("parse_error IS NULL")
    probed = analysis.probe_variants(variants, _playlists(spark, sf)).filter("encryption IS NOT NULL")
    return hls.encryption_rollup(probed, item="manifest_id")


@query("w15_recommended_variant", with_ctes(f""", {_VARS}, v AS (SELECT *, CASE WHEN rank = 1 THEN bandwidth * (manifest_id % 5) ELSE bandwidth END AS size_bytes FROM variants),
w AS (SELECT *, first_value(size_bytes) OVER (PARTITION BY manifest_id ORDER BY rank) AS top, max(CASE WHEN rank > 1 THEN size_bytes END) OVER (PARTITION BY manifest_id) AS rest FROM v)
SELECT manifest_id, rank, variant_id, rank = min(CASE WHEN size_bytes <= 1.5 * top THEN rank END) OVER (PARTITION BY manifest_id) AS recommended, rank = CASE WHEN top > 3 * rest THEN 2 ELSE 1 END AS preselected FROM w""", "manifests"))
def w15(spark, sf):
    variants = hls.hls_variants(_hls(spark, sf)).filter("parse_error IS NULL")
    sized = variants.withColumn("size_bytes", F.when(F.col("rank") == 1, F.col("bandwidth") * (F.col("manifest_id") % 5)).otherwise(F.col("bandwidth")))
    return hls.recommended_variant(sized, item="manifest_id").select("manifest_id", "rank", "variant_id", "recommended", "preselected")


@query("n10_nest_items", with_ctes(f", {_VARS} SELECT manifest_id, string_agg(variant_id, ',' ORDER BY rank) AS variant_ids, count(*)::INTEGER AS n FROM variants GROUP BY manifest_id", "manifests"))
def n10(spark, sf):
    nested = items.nest_items(hls.hls_variants(_hls(spark, sf)).filter("parse_error IS NULL"), key="manifest_id", order=["rank"])
    return nested.select("manifest_id", F.array_join("variants.variant_id", ",").alias("variant_ids"), F.size("variants").alias("n"))


@query("n10_flatten_items", with_ctes(f", {_VARS} SELECT manifest_id, rank, variant_id, bandwidth FROM variants", "manifests"))
def n10f(spark, sf):
    nested = items.nest_items(hls.hls_variants(_hls(spark, sf)).filter("parse_error IS NULL"), key="manifest_id", order=["rank"])
    return items.flatten_items(nested, key="manifest_id").select("manifest_id", "rank", "variant_id", "bandwidth")


# ---- DASH: DuckDB reads no XML, so the checks follow from how the manifests are built ----

def _mpd(spark, sf) -> DataFrame:
    return table(spark, sf, "mpd_manifests")


# what the recipe's four shapes hold, as rows; `n` is the number of segments, NULL where the duration decides
_REPS = """ok AS (SELECT doc_id, n_chars, lang, doc_id % 4 AS shape, doc_id % 3 * 60 + doc_id % 45 + 15.5 AS dur, doc_id % 9 = 4 AS live,
  'https://edge' || doc_id % 5 || '.media.test/d/' || doc_id || '/' AS base FROM documents WHERE doc_id % 13 < 11),
reps AS (
  SELECT doc_id, 0 AS pos, 'lo' AS rep_id, 'video' AS track_type, 700000 + n_chars AS bandwidth, '768x432' AS resolution, 'vp09.00.30.08' AS codecs, NULL AS lang, 90000 AS timescale, doc_id % 3 = 0 AS protected, ceil(dur / 4) AS n FROM ok WHERE shape = 0
  UNION ALL SELECT doc_id, 1, 'hi', 'video', 5200000, '2560x1440', NULL, NULL, 90000, doc_id % 3 = 0, ceil(dur / 4) FROM ok WHERE shape = 0
  UNION ALL SELECT doc_id, 2, 'snd', 'audio', 96000, NULL, 'opus', lang, 48000, false, 3 FROM ok WHERE shape = 0
  UNION ALL SELECT doc_id, 0, 'take-a', 'video', 3100000, '1600x900', NULL, NULL, 1, false, 3 FROM ok WHERE shape = 1
  UNION ALL SELECT doc_id, 1, 'voice', 'audio', 48000 + doc_id % 100, NULL, NULL, NULL, 10, false, 1 FROM ok WHERE shape = 1
  UNION ALL SELECT doc_id, 0, 'only', 'video', 1234567, '1024x576', NULL, NULL, 1, false, ceil(dur / 8) FROM ok WHERE shape = 2
  UNION ALL SELECT doc_id, 0, 't1', 'video', 2200000, '1366x768', NULL, NULL, 1000, false, 3 FROM ok WHERE shape = 3
  UNION ALL SELECT doc_id, 1, 'rep-1', 'video', 900000, NULL, NULL, NULL, NULL, false, 0 FROM ok WHERE shape = 3)"""
_BAD = "CASE WHEN doc_id % 13 = 12 THEN 'no MPD element' WHEN doc_id % 13 = 11 THEN 'xml parse error' END"


@query("s5_read_mpd", f"SELECT doc_id AS manifest_id, {_BAD} AS parse_error, CASE WHEN doc_id % 13 < 11 THEN CASE WHEN doc_id % 9 = 4 THEN 'dynamic' ELSE 'static' END END AS mpd_type FROM documents")
def s5(spark, sf):
    read = dash.read_mpd(_mpd(spark, sf))
    return read.select("manifest_id", "parse_error", F.when(F.col("parse_error").isNull(), F.col("mpd._type")).alias("mpd_type"))


@query("n5_mpd_representations", f"""
WITH {_REPS} SELECT doc_id AS manifest_id, rep_id, track_type, bandwidth, resolution, codecs, r.lang, live, dur::DOUBLE AS duration_sec, timescale::DOUBLE AS timescale, protected, NULL AS parse_error
FROM reps r JOIN ok USING (doc_id)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_BAD} FROM documents WHERE doc_id % 13 >= 11""")
def n5(spark, sf):
    reps = dash.mpd_representations(_mpd(spark, sf))
    live = F.when(F.col("parse_error").isNull(), F.col("live"))
    return reps.select("manifest_id", "rep_id", "track_type", "bandwidth", "resolution", "codecs", "lang", live.alias("live"), "duration_sec", "timescale", "protected", "parse_error")


@query("a11_drm_flag", "SELECT doc_id AS manifest_id, doc_id % 12 = 0 AS drm FROM documents WHERE doc_id % 13 < 11")
def a11(spark, sf):
    return dash.drm_flag(dash.mpd_representations(_mpd(spark, sf)))


_N6 = f"""WITH {_REPS} SELECT doc_id AS manifest_id, rep_id, i AS segment_index, first + i AS number, NULL::BIGINT AS time,
  base || CASE WHEN rep_id = 'only' THEN '1234567-' || (first + i) || '.bin' ELSE 'v/' || rep_id || '/' || printf('%04d', first + i) || '.webm' END AS segment_url
FROM (SELECT *, CASE WHEN rep_id = 'only' THEN 1 ELSE doc_id % 3 + 1 END AS first, unnest(range(0, n::BIGINT)) AS i FROM reps JOIN ok USING (doc_id) WHERE rep_id IN ('lo', 'hi', 'only'))"""


def _n7(snd: list[int], t1: list[int]) -> str:
    """Segments of the two timelines by the times at which they begin."""
    return f"""WITH {_REPS} SELECT doc_id AS manifest_id, rep_id, i - 1 AS segment_index, i AS number, times[i] AS time,
  base || CASE WHEN rep_id = 'snd' THEN 'snd/' || times[i] ELSE 't/' || printf('%09d', times[i]) END || '.bin' AS segment_url
FROM (SELECT *, unnest(range(1, len(times) + 1)) AS i FROM (SELECT *, (CASE WHEN rep_id = 'snd' THEN {snd} ELSE {t1} END)::BIGINT[] AS times FROM reps JOIN ok USING (doc_id) WHERE rep_id IN ('snd', 't1')))"""


_N8 = f"""WITH {_REPS} SELECT doc_id AS manifest_id, rep_id, i - 1 AS segment_index, NULL::BIGINT AS number, NULL::BIGINT AS time,
  CASE WHEN rep_id = 'voice' THEN regexp_extract(base, '^https://[^/]*') || '/abs/' || doc_id || '.bin' ELSE base || 'a/' || ['one', 'two', 'three'][i] || '.bin' END AS segment_url
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS i FROM reps JOIN ok USING (doc_id) WHERE rep_id IN ('take-a', 'voice'))"""


@query("n6_expand_number_template", _N6)
def n6(spark, sf):
    return dash.expand_number_template(dash.mpd_representations(_mpd(spark, sf)))


# without repeats an entry counts by its length: once where no segment duration is given, twice for the entry of two durations
@query("n7_expand_timeline", _n7([1200, 97200, 145200], [0, 8000, 16000]))
def n7(spark, sf):
    return dash.expand_timeline(dash.mpd_representations(_mpd(spark, sf)))


@query("n7_expand_timeline_honor_r", _n7([1200, 97200, 193200, 289200, 500000, 596000], [0, 9000]))
def n7r(spark, sf):
    return dash.expand_timeline(dash.mpd_representations(_mpd(spark, sf)), honor_r=True)


@query("n8_expand_segment_list", _N8)
def n8(spark, sf):
    return dash.expand_segment_list(dash.mpd_representations(_mpd(spark, sf)))


@query("n8_init_segments", f"""WITH {_REPS} SELECT doc_id AS manifest_id, rep_id, base || CASE rep_id WHEN 'snd' THEN 'snd/head' WHEN 'take-a' THEN 'head-a.bin' ELSE 'v/' || rep_id || '/head.webm' END AS init_segment_url
FROM reps JOIN ok USING (doc_id) WHERE rep_id IN ('lo', 'hi', 'snd', 'take-a')""")
def n8i(spark, sf):
    return dash.init_segments(dash.mpd_representations(_mpd(spark, sf)))


@query("n9_dash_items", f"""
WITH {_REPS}, v AS (SELECT *, coalesce(split_part(resolution, 'x', 2)::BIGINT, 0) AS h, n::BIGINT AS k FROM reps),
shown AS (SELECT doc_id, bool_or(protected) AS drm,
    string_agg(rep_id || ':' || CASE WHEN h >= 1080 THEN '1080p' WHEN h >= 720 THEN '720p' WHEN h >= 480 THEN '480p' WHEN h > 0 THEN h || 'p' ELSE '' END || ':' || k, ',' ORDER BY h DESC, bandwidth DESC, pos) FILTER (WHERE track_type = 'video') AS variants,
    string_agg(rep_id || ':' || coalesce(lang, '') || ':' || k, ',' ORDER BY pos) FILTER (WHERE track_type = 'audio' OR pos = 0) AS tracks FROM v GROUP BY doc_id)
SELECT d.doc_id AS manifest_id, CASE WHEN d.doc_id % 13 >= 11 THEN 'parse_failed' WHEN drm THEN 'protected' WHEN d.doc_id % 9 = 4 THEN 'unsupported' ELSE 'ready' END AS status,
  d.doc_id % 13 >= 11 OR NOT (drm OR d.doc_id % 9 = 4) AS downloadable,
  CASE WHEN d.doc_id % 13 < 11 THEN CASE WHEN drm THEN 'drm' WHEN d.doc_id % 9 = 4 THEN 'live' END END AS blocked_reason,
  CASE WHEN NOT drm THEN variants END AS variants, CASE WHEN NOT drm THEN tracks END AS tracks
FROM documents d LEFT JOIN shown USING (doc_id)""")
def n9(spark, sf):
    out = dash.dash_items(_mpd(spark, sf))
    shown = lambda col, *names: F.array_join(F.transform(col, lambda v: F.concat_ws(":", *[F.coalesce(v[n].cast("string"), F.lit("")) for n in names])), ",")
    return out.select("manifest_id", "status", "downloadable", "blocked_reason", shown("variants", "variant_id", "quality_label", "segment_count").alias("variants"),
                      shown("tracks", "track_id", "lang", "segment_count").alias("tracks"))
