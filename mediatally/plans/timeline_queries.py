"""Queries over fragment timelines, sample tables and stream types."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediatally.functions import media
from mediatally.operators import timeline
from mediatally.plans.registry import query
from mediatally.plans.tables import table, with_ctes

_TOP = "tops AS (SELECT *, max(decode_time) OVER (PARTITION BY file_id, track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fragments)"


@query("w5_validate_timeline", with_ctes(f""", {_TOP}, f AS (SELECT file_id, count(*) AS fragment_count, count(*) FILTER (WHERE decode_time < top) AS regressions, min(seq) FILTER (WHERE decode_time < top) AS first_bad_seq,
  arg_min(track_id, seq) FILTER (WHERE decode_time < top) AS t, max(seq) AS expected FROM tops GROUP BY file_id)
SELECT file_id, fragment_count, regressions, first_bad_seq, fragment_count >= expected * 0.9 AND t IS NULL AS ok,
  CASE WHEN fragment_count < expected * 0.9 THEN 'fragment_count_' || fragment_count || '_of_' || expected WHEN t IS NOT NULL THEN 'tfdt_regression_track' || t END AS reason FROM f""", "fragments"))
def w5(spark, sf):
    fragments = table(spark, sf, "fragments")
    return timeline.validate_timeline(fragments, fragments.groupBy("file_id").agg(F.max("seq").alias("expected")))


@query("w6_repair_timeline", with_ctes(f", {_TOP} SELECT file_id, track_id, seq, greatest(decode_time, top) AS fixed_time, coalesce(decode_time < top, false) AS repaired FROM tops", "fragments"))
def w6(spark, sf):
    return timeline.repair_timeline(table(spark, sf, "fragments")).select("file_id", "track_id", "seq", "fixed_time", "repaired")


def _rle_sql(column: str) -> str:
    return with_ctes(f""", c AS (SELECT *, CASE WHEN {column} IS DISTINCT FROM lag({column}) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS change FROM samples WINDOW w AS (PARTITION BY file_id, track_id ORDER BY seq)),
r AS (SELECT *, CAST(sum(change) OVER (PARTITION BY file_id, track_id ORDER BY seq) AS BIGINT) AS run_no FROM c)
SELECT file_id, track_id, run_no, min(seq) AS first_pos, min({column}) AS run_value, count(*) AS run_length FROM r GROUP BY file_id, track_id, run_no""", "samples")


@query("w7_run_length_durations", _rle_sql("sample_duration"))
def w7(spark, sf):
    return timeline.run_length(table(spark, sf, "samples"), "sample_duration")


@query("w7_run_length_offsets", _rle_sql("cts_offset"))
def w7o(spark, sf):
    return timeline.run_length(table(spark, sf, "samples"), "cts_offset")


_PLACED = "placed AS (SELECT *, CAST(sum(sample_size) OVER (PARTITION BY file_id ORDER BY src_offset) - sample_size AS BIGINT) AS new_offset FROM samples)"
_CHUNKS = _PLACED + """, c AS (SELECT *, CASE WHEN new_offset IS DISTINCT FROM lag(new_offset + sample_size) OVER (PARTITION BY file_id, track_id ORDER BY seq) THEN 1 ELSE 0 END AS fresh FROM placed),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_id, track_id ORDER BY seq) AS BIGINT) AS chunk_no FROM c),
chunks AS (SELECT file_id, track_id, chunk_no, min(new_offset) AS chunk_offset, count(*) AS sample_count, CAST(sum(sample_size) AS BIGINT) AS chunk_bytes FROM n GROUP BY ALL)"""


def _chunks(samples):
    busy = timeline.busy_files(samples)
    return timeline.contiguous_chunks(timeline.assign_offsets(samples, busy=busy), busy=busy), busy


@query("w8_contiguous_chunks", with_ctes(f", {_CHUNKS} SELECT * FROM chunks", "samples"))
def w8(spark, sf):
    return _chunks(table(spark, sf, "samples"))[0]


@query("w7_run_length_chunks", with_ctes(f""", {_CHUNKS}, d AS (SELECT *, CASE WHEN sample_count IS DISTINCT FROM lag(sample_count) OVER (PARTITION BY file_id, track_id ORDER BY chunk_no) THEN 1 ELSE 0 END AS change FROM chunks),
r AS (SELECT *, CAST(sum(change) OVER (PARTITION BY file_id, track_id ORDER BY chunk_no) AS BIGINT) AS run_no FROM d)
SELECT file_id, track_id, run_no, min(chunk_no) AS first_pos, min(sample_count) AS run_value, count(*) AS run_length FROM r GROUP BY file_id, track_id, run_no""", "samples"))
def w7c(spark, sf):
    chunks, busy = _chunks(table(spark, sf, "samples"))
    return timeline.run_length(chunks, "sample_count", order="chunk_no", busy=busy)


@query("w9_assign_offsets", with_ctes(f", {_PLACED} SELECT file_id, track_id, seq, new_offset FROM placed", "samples"))
def w9(spark, sf):
    return timeline.assign_offsets(table(spark, sf, "samples")).select("file_id", "track_id", "seq", "new_offset")


@query("w10_sync_index", with_ctes("""
, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, track_id ORDER BY seq) AS sample_no, count(*) OVER (PARTITION BY file_id, track_id) AS total, count(*) FILTER (WHERE is_sync) OVER (PARTITION BY file_id, track_id) AS synced FROM samples)
SELECT file_id, track_id, seq, sample_no FROM n WHERE is_sync AND synced < total""", "samples"))
def w10(spark, sf):
    return timeline.sync_index(table(spark, sf, "samples"))


@query("a13_duration_totals", with_ctes("SELECT file_id, track_id, count(*) AS sample_count, CAST(sum(sample_duration) AS BIGINT) AS total_duration, CAST(sum(sample_size) AS BIGINT) AS total_bytes FROM samples GROUP BY file_id, track_id", "samples"))
def a13(spark, sf):
    return timeline.duration_totals(table(spark, sf, "samples"))


_CENSUS = """census AS (SELECT segment_id, CASE WHEN bool_or(stream_type = 27) THEN 'h264' WHEN bool_or(stream_type IN (36, 37)) THEN 'hevc' WHEN bool_or(stream_type = 2) THEN 'mpeg2' ELSE 'unknown' END AS video,
  CASE WHEN bool_or(stream_type IN (15, 17)) THEN 'aac' WHEN bool_or(stream_type = 129) THEN 'ac3' WHEN bool_or(stream_type = 3) THEN 'mp3' ELSE 'unknown' END AS audio FROM stream_types GROUP BY segment_id)"""


@query("a10_codec_census", with_ctes(f""", {_CENSUS} SELECT segment_id, video, audio, CASE video WHEN 'h264' THEN 'H.264' WHEN 'hevc' THEN 'HEVC (H.265)' WHEN 'mpeg2' THEN 'MPEG-2' ELSE 'unknown' END || ' + ' ||
  CASE audio WHEN 'aac' THEN 'AAC' WHEN 'ac3' THEN 'AC3' WHEN 'mp3' THEN 'MP3' ELSE 'unknown' END AS label FROM census""", "stream_types"))
def a10(spark, sf):
    return timeline.codec_census(table(spark, sf, "stream_types"))


@query("f12_is_transmuxable", with_ctes(f", {_CENSUS} SELECT segment_id, video = 'h264' AND audio IN ('aac', 'unknown') AS transmuxable FROM census", "stream_types"))
def f12(spark, sf):
    census = timeline.codec_census(table(spark, sf, "stream_types"))
    return census.select("segment_id", media.is_transmuxable(F.col("video"), F.col("audio")).alias("transmuxable"))
