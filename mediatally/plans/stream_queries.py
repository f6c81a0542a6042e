"""Queries that run a stream over the tables' files; the SQL is that of the batch twin where results are final."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, urls
from mediatally.operators import admission
from mediatally.plans.detect_queries import ATTRIBUTED, HTTP, KIND, NORMALIZED, SQL_W1, STAGED, TRACKS, sql_dir, sql_norm
from mediatally.plans.registry import query
from mediatally.plans.tables import table, with_ctes
from mediatally.sources.requests import normalize_request
from mediatally.streaming import requests as streams
from mediatally.streaming import tasks as task_streams
from mediatally.session import scratch_dir, stage
from mediatally.streaming.keyed import KeyedTable
from mediatally.streaming.run import LAST_MS, closable, drain, drain_counted, drain_updates, feed, stream_table


def _requests(spark, sf) -> DataFrame:
    return stream_table(spark, sf, "requests")


# the row that ends a stream
END = {"request_id": -1, "tab_id": -1, "kind": "nav"}


def _log(spark, sf) -> DataFrame:
    return _requests(spark, sf).select("request_id", "tab_id", "ts_ms", "kind", "url")


def _http(spark, sf) -> DataFrame:
    return normalize_request(admission.admit_http(_requests(spark, sf).filter("kind = 'http'")))


@query("r1_stream_dedup_60s", SQL_W1)
def r1(spark, sf):
    stream, close = closable(_requests(spark, sf).filter("kind = 'http'").select("request_id", "tab_id", "ts_ms", "url"), **END)
    return drain(streams.stream_dedup_60s(stream), "r1", close=close)


@query("r1_stream_dedup_approximate")
def r1a(spark, sf):
    stream = _requests(spark, sf).filter("kind = 'http'").select("request_id", "tab_id", "ts_ms", "url")
    return drain(streams.stream_dedup_approximate(stream), "r1a")


# a change is put out when no other change and no page load came before its quiet time was over
@query("r2_stream_track_groups", with_ctes(f""", {TRACKS},
running AS (SELECT *, max(CASE WHEN track_type = 'video' THEN codec_id END) OVER w AS pv, max(CASE WHEN track_type = 'audio' THEN codec_id END) OVER w AS pa FROM typed
  WINDOW w AS (PARTITION BY tab_id, epoch, group_id ORDER BY ts_ms, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
changes AS (SELECT *, ts_ms + 1200 AS ready_ms, CASE WHEN track_type = 'video' THEN codec_id ELSE pv END AS video_codec, CASE WHEN track_type = 'audio' THEN codec_id ELSE pa END AS audio_codec,
  lead(ts_ms) OVER (PARTITION BY tab_id, epoch, group_id ORDER BY ts_ms, request_id) AS next_ms FROM running
  WHERE CASE WHEN track_type = 'video' THEN pv IS NULL OR codec_id > pv ELSE pa IS NULL OR codec_id > pa END),
loads AS (SELECT tab_id, epoch - 1 AS epoch, min(ts_ms) AS nav_ms FROM staged WHERE kind = 'nav' GROUP BY tab_id, epoch)
SELECT tab_id, group_id, video_codec, audio_codec, ready_ms FROM changes LEFT JOIN loads USING (tab_id, epoch)
WHERE video_codec IS NOT NULL AND ready_ms <= coalesce(next_ms, ready_ms) AND ready_ms <= coalesce(nav_ms, ready_ms)""", "requests"))
def r2(spark, sf):
    stream, close = closable(_log(spark, sf), **END)
    return drain(streams.stream_track_groups(stream), "r2", close=close)


@query("r2_stream_track_groups_by_session")
def r2s(spark, sf):
    return drain(streams.stream_track_groups_by_session(_requests(spark, sf), watermark="10 seconds"), "r2s")


@query("r3_stream_items", with_ctes(f""", {HTTP}
SELECT tab_id, {sql_norm('url')} AS dedup_key, min(ts_ms) AS detected_ms, max(ts_ms) AS updated_ms, count(*) AS hint_count, arg_min(size, request_id) FILTER (WHERE size > 0) AS size_estimate
FROM http GROUP BY ALL""", "requests"))
def r3(spark, sf):
    stream = _http(spark, sf).select("request_id", "tab_id", "ts_ms", "url", "size")
    return streams.current_items(drain_updates(streams.stream_items(stream), "r3"))


@query("r4_stream_navigation_reset", with_ctes(f", {STAGED} SELECT tab_id, epoch, {sql_norm('url')} AS dedup_key, min(ts_ms) AS detected_ms FROM staged WHERE kind = 'http' GROUP BY ALL", "requests"))
def r4(spark, sf):
    stream, close = closable(_log(spark, sf), **END)
    return drain(streams.stream_navigation_reset(stream), "r4", close=close)


@query("r5_stream_live_states", with_ctes("""
, g AS (SELECT *, CASE WHEN saved_ms - lag(saved_ms) OVER (PARTITION BY tab_id ORDER BY saved_ms) > 43200000 THEN 1 ELSE 0 END AS new FROM tab_saves),
n AS (SELECT *, sum(new) OVER (PARTITION BY tab_id ORDER BY saved_ms) AS state FROM g)
SELECT tab_id, min(saved_ms) AS first_saved_ms, max(saved_ms) AS saved_ms, count(*) AS saves, max(saved_ms) + 43200000 AS expired_ms FROM n GROUP BY tab_id, state""", "tab_saves"))
def r5(spark, sf):
    stream, close = closable(stream_table(spark, sf, "tab_saves"), tab_id=-1, saved_ms=LAST_MS)
    return drain(streams.stream_live_states(stream), "r5", close=close)


# segments of a page that is still open when the log ends go on waiting
@query("r6_stream_first_manifests", with_ctes(f""", {ATTRIBUTED}, shown AS (SELECT tab_id, max(epoch) AS epoch FROM staged GROUP BY tab_id)
SELECT tab_id, a.epoch, dir, segment_count, dedup_key FROM attributed a JOIN shown s USING (tab_id) WHERE dedup_key IS NOT NULL OR a.epoch < s.epoch""", "requests"))
def r6f(spark, sf):
    http = _http(spark, sf).filter(~urls.is_track_url(F.col("url")) & media.looks_like_media(F.col("url"), F.col("mime"), F.col("has_range")))
    loads = normalize_request(_requests(spark, sf).filter("kind = 'nav'"))
    names = ["request_id", "tab_id", "ts_ms", "kind", "url", "mime"]
    stream, close = closable(http.select(*names).unionByName(loads.select(*names)), **END)
    counts = drain(streams.stream_first_manifests(stream), "r6f", close=close)
    return counts.groupBy("tab_id", "epoch", "dir", "dedup_key").agg(F.sum("segment_count").alias("segment_count"))


@query("r6_stream_pending_segments", with_ctes(f""", {NORMALIZED}, k AS (SELECT tab_id, {sql_norm('url')} AS norm, {KIND} AS kind_ FROM normalized WHERE url LIKE 'http%'),
s AS (SELECT DISTINCT tab_id, {sql_dir('norm')} AS dir FROM k WHERE kind_ = 'segment'), m AS (SELECT DISTINCT tab_id, norm AS dedup_key, {sql_dir('norm')} AS mdir FROM k WHERE kind_ = 'manifest')
SELECT s.tab_id, s.dir, m.dedup_key FROM s JOIN m ON s.tab_id = m.tab_id AND starts_with(s.dir, m.mdir)""", "requests"))
def r6(spark, sf):
    def hints(kind):
        df = normalize_request(_requests(spark, sf)).filter("url LIKE 'http%'")
        return df.filter(media.classify_hint(F.col("url"), F.col("mime")) == kind).select("tab_id", "ts_ms", "url")

    # a pair that meets in several slots comes once for each
    (s, close_s), (m, close_m) = (closable(hints(kind), tab_id=-1, url="https://end.invalid/") for kind in ("segment", "manifest"))
    joined = streams.stream_pending_segments(s, m, watermark="2 hours", wait="2 hours")
    return drain(joined, "r6", close=lambda: (close_s(), close_m())).select("tab_id", "dir", "dedup_key").distinct()


_NOTICES = """, w AS (SELECT ts_ms // 2000 * 2000 AS window_ms, count(*) AS completions, min('task-' || task_id) AS a, max('task-' || task_id) AS b FROM task_events WHERE stage = 'done' GROUP BY 1)
SELECT window_ms, completions, unnest(CASE WHEN completions >= 3 THEN [completions || ' completed'] WHEN completions = 2 THEN [a, b] ELSE [a] END) AS notice FROM w"""


@query("r8_coalesce_completions", with_ctes(_NOTICES, "task_events"))
def r8(spark, sf):
    done = task_streams.finished_tasks(table(spark, sf, "task_events"))
    return task_streams.completion_notices(task_streams.completion_windows(done))


@query("r8_stream_completions", with_ctes(_NOTICES, "task_events"))
def r8s(spark, sf):
    updates = drain_updates(task_streams.stream_completions(stream_table(spark, sf, "task_events")), "r8")
    latest = updates.groupBy("window_ms").agg(F.max_by(F.struct("completions", "first_title", "last_title"), "batch_id").alias("l"))
    return task_streams.completion_notices(latest.select("window_ms", "l.*"))


@query("r10_stream_task_state", with_ctes("SELECT task_id, arg_max(stage, ts_ms * 10 + seq) AS stage, max(ts_ms) AS updated_ms FROM task_events GROUP BY task_id", "task_events"))
def r10(spark, sf):
    updates = drain_updates(task_streams.stream_task_state(stream_table(spark, sf, "task_events")), "r10")
    return updates.groupBy("task_id").agg(F.max_by("stage", "batch_id").alias("stage"), F.max_by("updated_ms", "batch_id").alias("updated_ms"))


@query("r11_stream_await_audio")
def r11(spark, sf):
    def tracks(kind):
        df = _http(spark, sf).withColumn("_t", urls.parse_track_url(F.col("url"))).filter(F.col("_t.track_type") == kind)
        return df.select("tab_id", "ts_ms", F.col("_t.group_id").alias("group_id"), F.col("_t.codec_id").alias("codec_id"))

    return drain(streams.stream_await_audio(tracks("video"), tracks("audio"), watermark="5 seconds"), "r11")


@query("r11_stream_first_audio", with_ctes(f""", {TRACKS}
SELECT v.tab_id, v.group_id, v.request_id, min(a.ts_ms) AS audio_ts_ms, min(a.ts_ms) IS NULL AS silent
FROM typed v LEFT JOIN typed a ON a.track_type = 'audio' AND a.tab_id = v.tab_id AND a.group_id = v.group_id AND a.ts_ms BETWEEN v.ts_ms AND v.ts_ms + 12000
WHERE v.track_type = 'video' GROUP BY v.tab_id, v.group_id, v.request_id""", "requests"))
def r11f(spark, sf):
    parsed = _http(spark, sf).withColumn("_t", urls.parse_track_url(F.col("url"))).filter("_t IS NOT NULL")
    tracks = parsed.select("tab_id", "request_id", "ts_ms", F.col("_t.group_id").alias("group_id"), F.col("_t.track_type").alias("track_type"), F.col("_t.codec_id").alias("codec_id"))
    stream, close = closable(tracks, tab_id=-1, request_id=-1, group_id="", track_type="audio", codec_id=0)
    out = drain(streams.stream_first_audio(stream), "r11f", close=close)
    return out.select("tab_id", "group_id", "request_id", "audio_ts_ms", "silent")


@query("r12_closed_window_counts", with_ctes("""
SELECT * FROM (SELECT tab_id, ts_ms // 10000 * 10000 AS window_ms, count(*) AS requests FROM requests GROUP BY 1, 2) w
WHERE window_ms + 10000 <= (SELECT max(ts_ms) FROM requests) - 30000""", "requests"))
def r12(spark, sf):
    return drain(streams.closed_window_counts(_requests(spark, sf).select("tab_id", "ts_ms")), "r12")


@query("r7_stream_progress", with_ctes(f"""
, c AS (SELECT task_id % 200 AS task_id, 1704067200000 + task_id * 250 + segment_index * 30 + attempt AS ts_ms, task_id * 32 + segment_index * 4 + attempt AS seq, bytes * 40 AS bytes FROM fetch_attempts WHERE status_code = 200),
t AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY task_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM c)
SELECT task_id, ts_ms, seq, total_bytes FROM t WHERE total_bytes // 8388608 > (total_bytes - bytes) // 8388608""", "fetch_attempts"))
def r7s(spark, sf):
    # lineitem is aggregated before it gives attempts: the stream reads them from a stored table
    kept = stage(table(spark, sf, "fetch_attempts").filter("status_code = 200").selectExpr(
        "task_id % 200 AS task_id", "1704067200000 + task_id * 250 + segment_index * 30 + attempt AS ts_ms",
        "CAST(task_id * 32 + segment_index * 4 + attempt AS BIGINT) AS seq", "bytes * 40 AS bytes"), "chunks")
    chunks = spark.readStream.schema(kept.schema).parquet(*{f.rsplit("/", 1)[0] for f in kept.inputFiles()[:1]})
    stream, close = closable(chunks, task_id=-1, seq=0, bytes=0)
    return drain(task_streams.stream_progress(stream, pause_ms=0), "r7", close=close)


@query("s8_stream_upsert", with_ctes(f""", {HTTP}
SELECT tab_id, {sql_norm('url')} AS dedup_key, min(ts_ms) AS detected_ms, arg_max(url, request_id) AS url, arg_max(status_code, request_id) AS status_code
FROM http GROUP BY ALL""", "requests"))
def s8s(spark, sf):
    schema = "tab_id bigint, dedup_key string, detected_ms bigint, url string, status_code int, ts_ms bigint, request_id bigint"
    kept = KeyedTable(spark, scratch_dir(spark, "s8-items"), schema, keys=["tab_id", "dedup_key"], order=["ts_ms", "request_id"], first="detected_ms")
    hints = _http(spark, sf).select("tab_id", urls.normalize_url(F.col("url")).alias("dedup_key"), F.col("ts_ms").alias("detected_ms"),
                                    "url", "status_code", "ts_ms", "request_id")
    feed(hints, "s8", kept.upsert)
    return kept.current().select("tab_id", "dedup_key", "detected_ms", "url", "status_code")


# every tenth request arrives once more when the log is over, far behind the watermark
@query("r12_late_rows", with_ctes("SELECT count(*) AS rows_late FROM requests WHERE request_id % 10 = 0", "requests"))
def r12_late(spark, sf):
    log = table(spark, sf, "requests").select("request_id", "tab_id", "ts_ms", "url")
    late = log.filter("request_id % 10 = 0").withColumn("ts_ms", F.col("ts_ms") - 10**9)
    folder = scratch_dir(spark, "late-log")
    log.write.parquet(folder)
    stream = spark.readStream.schema(log.schema).parquet(folder)
    # a batch tests for lateness with the watermark of the one before, so the late rows come two batches on
    more = [lambda part=part: part.write.mode("append").parquet(folder) for part in (log.filter("request_id = 0"), late)]
    counted = drain_counted(streams.stream_dedup_60s(stream, watermark="10 days"), "r12-late", "append", *more)
    return counted.progress.agg(F.sum("rows_late").alias("rows_late"))
