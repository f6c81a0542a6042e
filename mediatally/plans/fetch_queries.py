"""Queries over fetch attempts, segment stores, tasks and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, text
from mediatally.operators import fetch
from mediatally.plans.registry import query
from mediatally.plans.scalar_queries import LISTED, listed_items
from mediatally.plans.tables import table, with_ctes
from mediatally.sources import segments


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


attempts, tasks, store, events = _t("fetch_attempts"), _t("tasks"), _t("segment_store"), _t("task_events")

OUTCOMES = """decided AS (SELECT task_id, segment_index, min(attempt) FILTER (WHERE status_code BETWEEN 200 AND 399 OR status_code IN (401, 403, 404) OR attempt >= 3) AS last FROM fetch_attempts WHERE attempt <= 3 GROUP BY task_id, segment_index),
outcomes AS (SELECT d.task_id, d.segment_index, CASE WHEN a.status_code BETWEEN 200 AND 399 THEN 'completed' WHEN a.status_code = 404 THEN 'missing' ELSE 'failed' END AS outcome, CAST(d.last + 1 AS BIGINT) AS attempts,
  a.status_code IN (401, 403) AS credential, (SELECT count(*) FROM fetch_attempts t WHERE t.task_id = d.task_id AND t.segment_index = d.segment_index AND t.attempt <= d.last AND t.status_code IN (429, 503)) AS throttled,
  CASE WHEN a.status_code BETWEEN 200 AND 399 THEN a.bytes END AS bytes
  FROM decided d JOIN fetch_attempts a ON a.task_id = d.task_id AND a.segment_index = d.segment_index AND a.attempt = d.last)"""


@query("a5_fetch_outcomes", with_ctes(f", {OUTCOMES} SELECT * FROM outcomes", "fetch_attempts"))
def a5(spark, sf):
    return fetch.fetch_outcomes(attempts(spark, sf))


@query("a6_task_outcomes", with_ctes(f""", {OUTCOMES} SELECT task_id, count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  count(*) FILTER (WHERE outcome = 'missing') AS missing, CAST(sum(throttled) AS BIGINT) AS throttled, CASE WHEN bool_or(credential) THEN 'credential' WHEN count(*) FILTER (WHERE outcome = 'missing') > 2 THEN 'missing' END AS abort_reason,
  CAST(CASE WHEN sum(throttled) > 2 THEN 3 ELSE 4 END AS BIGINT) AS suggested_concurrency FROM outcomes GROUP BY task_id""", "fetch_attempts"))
def a6(spark, sf):
    return fetch.task_outcomes(fetch.fetch_outcomes(attempts(spark, sf)))


# some tasks could not open segments, some were canceled, and every task should have segments 0 to 8
_TROUBLED = OUTCOMES.replace("attempt >= 3)", "attempt >= 3 OR error)").replace("FROM fetch_attempts", "FROM tried").replace("JOIN fetch_attempts", "JOIN tried").replace(
    "CASE WHEN a.status_code BETWEEN", "CASE WHEN a.error THEN 'failed' WHEN a.status_code BETWEEN", 1).replace(
    "a.status_code IN (401, 403) AS credential", "a.status_code IN (401, 403) AND NOT a.error AS credential, a.error AS decrypt")


@query("a6_task_outcomes_with_aborts", with_ctes(f""", tried AS (SELECT *, task_id % 53 = 1 AND segment_index = 2 AND attempt = 0 AS error FROM fetch_attempts), {_TROUBLED},
every AS (SELECT task_id, unnest(range(0, 9)) AS segment_index FROM tasks),
lost AS (SELECT task_id, count(*) AS aborted FROM every e WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.task_id = e.task_id AND o.segment_index = e.segment_index) GROUP BY task_id),
c AS (SELECT task_id, count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'missing') AS missing,
  CAST(coalesce(sum(throttled), 0) AS BIGINT) AS throttled, coalesce(bool_or(credential), false) AS credential, coalesce(bool_or(decrypt), false) AS decrypt FROM outcomes GROUP BY task_id),
r AS (SELECT task_id, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(missing, 0) AS missing, coalesce(aborted, 0) AS aborted, coalesce(throttled, 0) AS throttled,
  CASE WHEN credential THEN 'credential' WHEN decrypt THEN 'decrypt' WHEN missing > 2 THEN 'missing' WHEN task_id IN (SELECT task_id FROM tasks WHERE stage = 'canceled') THEN 'canceled' END AS abort_reason
  FROM c FULL JOIN lost USING (task_id))
SELECT task_id, completed, failed + CASE WHEN abort_reason <> 'missing' THEN aborted ELSE 0 END AS failed, missing, aborted, throttled, abort_reason,
  CAST(CASE WHEN throttled > 2 THEN 3 ELSE 4 END AS BIGINT) AS suggested_concurrency FROM r""", "fetch_attempts", "tasks"))
def a6_aborts(spark, sf):
    unopened = (F.col("task_id") % 53 == 1) & (F.col("segment_index") == 2) & (F.col("attempt") == 0)
    tried = attempts(spark, sf).withColumn("error", F.when(unopened, F.lit("decrypt_failed")))
    every = tasks(spark, sf).select("task_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))).alias("segment_index"))
    return fetch.task_outcomes(fetch.fetch_outcomes(tried), expected=every, canceled=tasks(spark, sf).filter("stage = 'canceled'"))


@query("a7_task_rollup", with_ctes(f""", {OUTCOMES}, o AS (SELECT *, outcome = 'completed' AS done, segment_index > 4 AS audio FROM outcomes)
SELECT task_id, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE done) AS completed_segments, count(*) AS total_segments, count(*) FILTER (WHERE done AND NOT audio) AS video_completed,
  count(*) FILTER (WHERE NOT audio) AS video_total, count(*) FILTER (WHERE done AND audio) AS audio_completed, count(*) FILTER (WHERE audio) AS audio_total FROM o GROUP BY task_id""", "fetch_attempts"))
def a7(spark, sf):
    return fetch.task_rollup(fetch.fetch_outcomes(attempts(spark, sf)), F.col("segment_index") > 4)


@query("a8_task_panel", with_ctes("""
SELECT CASE WHEN stage IN ('queued', 'downloading', 'decrypting', 'merging', 'transcoding') THEN 'active' WHEN stage = 'done' THEN 'done' ELSE 'failed' END AS panel, count(*) AS tasks FROM tasks WHERE stage <> 'canceled' GROUP BY panel""", "tasks"))
def a8(spark, sf):
    return fetch.task_panel(tasks(spark, sf))


@query("w12_backoff_schedule", with_ctes("""
, w AS (SELECT task_id, segment_index, attempt, CAST(CASE WHEN status_code = 503 THEN 8000 ELSE least(500 * 2 ** attempt, 8000) END AS BIGINT) AS wait_ms FROM fetch_attempts WHERE status_code IN (0, 503) AND attempt < 3)
SELECT *, CAST(sum(wait_ms) OVER (PARTITION BY task_id, segment_index ORDER BY attempt) AS BIGINT) AS total_wait_ms FROM w""", "fetch_attempts"))
def w12(spark, sf):
    return fetch.backoff_schedule(attempts(spark, sf)).select("task_id", "segment_index", "attempt", "wait_ms", "total_wait_ms")


_OPEN = "(SELECT media_id FROM tasks WHERE stage NOT IN ('done', 'canceled'))"


@query("j4_dedup_tasks", with_ctes(f"SELECT c_custkey AS media_id, c_custkey IN {_OPEN} AS duplicate FROM customer", "tasks"))
def j4(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("media_id"))
    accepted, duplicate = fetch.dedup_tasks(new, tasks(spark, sf))
    return accepted.withColumn("duplicate", F.lit(False)).unionByName(duplicate.withColumn("duplicate", F.lit(True)))


@query("j5_orphan_segments", with_ctes("SELECT task_id, segment_index, bytes FROM segment_store WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE stage <> 'canceled')", "segment_store", "tasks"))
def j5(spark, sf):
    return fetch.orphan_segments(store(spark, sf), tasks(spark, sf).filter("stage <> 'canceled'")).select("task_id", "segment_index", "bytes")


_EXPECTED = "expected AS (SELECT DISTINCT task_id, segment_index FROM fetch_attempts)"


def _expected(spark, sf) -> DataFrame:
    return attempts(spark, sf).select("task_id", "segment_index").distinct()


@query("j6_resume_todo", with_ctes(f", {_EXPECTED} SELECT task_id, segment_index FROM expected EXCEPT SELECT task_id, segment_index FROM segment_store", "fetch_attempts", "segment_store"))
def j6(spark, sf):
    return fetch.resume_todo(_expected(spark, sf), store(spark, sf))


_PLAN = "plan AS (SELECT task_id, max(segment_index) + 1 AS n FROM fetch_attempts GROUP BY task_id)"


@query("j7_missing_segments", with_ctes(f""", {_PLAN}, e AS (SELECT task_id, unnest(range(0, n)) AS segment_index FROM plan)
SELECT task_id, count(*) AS expected, count(bytes) AS present, count(*) - count(bytes) AS missing, min(segment_index) FILTER (WHERE bytes IS NULL) AS first_missing,
  CASE WHEN count(*) - count(bytes) <= 2 THEN 'continue' ELSE 'abort' END AS decision FROM e LEFT JOIN segment_store USING (task_id, segment_index) GROUP BY task_id""", "fetch_attempts", "segment_store"))
def j7(spark, sf):
    plan = attempts(spark, sf).groupBy("task_id").agg((F.max("segment_index") + 1).alias("segment_count"))
    return fetch.missing_segments(fetch.expand_expected(plan), store(spark, sf))


@query("j8_select_variant", with_ctes("""
, c AS (SELECT c_custkey AS item_id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'o' || (SELECT max(o_orderkey) FROM orders o WHERE o_custkey = c_custkey) ELSE 'gone' END AS variant_id FROM customer)
SELECT item_id, variant_id, coalesce(CASE WHEN variant_id <> 'gone' THEN variant_id END, 'o' || (SELECT arg_min(o_orderkey, o_orderkey) FROM orders WHERE o_custkey = item_id)) AS selected_id FROM c"""))
def j8(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("item_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("variant_id"), F.col("o_orderkey").alias("rank"))
    top = orders.groupBy("item_id").agg(F.max_by("variant_id", "rank").alias("top"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id")).join(top, "item_id", "left")
    choice = F.when(F.col("item_id") % 3 == 1, F.col("top")).when(F.col("item_id") % 3 == 2, F.lit("gone"))
    return fetch.select_variant(customers.select("item_id", choice.alias("variant_id")), orders)


@query("j3_join_live_or_snapshot", with_ctes(f""", {LISTED}
SELECT t.task_id, t.media_id, t.tab_id, CASE WHEN l.media_id IS NOT NULL THEN 'live' WHEN t.stage = 'paused' THEN 'snapshot' WHEN k.task_id IS NOT NULL THEN 'shell' ELSE 'media_gone' END AS media_source,
  coalesce(l.title, CASE WHEN t.stage = 'paused' THEN 'kept ' || t.task_id END) AS title
FROM tasks t LEFT JOIN listed l ON l.media_id = t.media_id AND l.tab_id = t.tab_id LEFT JOIN (SELECT DISTINCT task_id FROM segment_store) k ON k.task_id = t.task_id""", "items", "tasks", "segment_store"))
def j3(spark, sf):
    live = listed_items(spark, sf)
    frozen = tasks(spark, sf).filter("stage = 'paused'").select("task_id", F.concat(F.lit("kept "), F.col("task_id").cast("string")).alias("title"))
    return fetch.join_live_or_snapshot(tasks(spark, sf), live, frozen, store(spark, sf))


_OLD = "SELECT task_id, segment_index FROM fetch_attempts WHERE status_code = 200 AND attempt % 2 = 0"
_NEW = "SELECT task_id, segment_index FROM fetch_attempts WHERE status_code = 200 AND attempt % 2 = 1"


def _old_new(spark, sf):
    done = attempts(spark, sf).filter("status_code = 200")
    pick = lambda n: done.filter(F.col("attempt") % 2 == n).select("task_id", "segment_index")
    return pick(0), pick(1)


@query("u2_merge_completed", with_ctes(f"{_OLD} UNION {_NEW}", "fetch_attempts"))
def u2(spark, sf):
    return fetch.merge_completed(*_old_new(spark, sf))


@query("u3_except", with_ctes(f"{_NEW} EXCEPT {_OLD}", "fetch_attempts"))
def u3(spark, sf):
    old, new = _old_new(spark, sf)
    return fetch.except_rows(new, old)


@query("u4_intersect", with_ctes(f"{_OLD} INTERSECT {_NEW}", "fetch_attempts"))
def u4(spark, sf):
    return fetch.intersect_rows(*_old_new(spark, sf))


@query("t5_latest_tasks", with_ctes("SELECT task_id, created_ms, stage FROM tasks ORDER BY created_ms DESC, task_id DESC LIMIT 50", "tasks"))
def t5(spark, sf):
    return fetch.latest_tasks(tasks(spark, sf)).select("task_id", "created_ms", "stage")


@query("t8_ordered_segments", with_ctes("SELECT task_id, segment_index, bytes FROM segment_store ORDER BY 1, 2", "segment_store"))
def t8(spark, sf):
    return fetch.ordered_segments(store(spark, sf)).select("task_id", "segment_index", "bytes")


@query("r9_restore_tasks", with_ctes("""SELECT task_id, CASE WHEN stage IN ('downloading', 'queued', 'decrypting', 'merging') THEN 'paused' ELSE stage END AS stage,
  CASE WHEN stage IN ('downloading', 'queued', 'decrypting', 'merging') THEN 'interrupted' END AS error_message FROM tasks""", "tasks"))
def r9(spark, sf):
    return fetch.restore_tasks(tasks(spark, sf)).select("task_id", "stage", "error_message")


@query("r10_task_state", with_ctes("SELECT task_id, arg_max(stage, ts_ms * 10 + seq) AS stage, max(ts_ms) AS updated_ms FROM task_events GROUP BY task_id", "task_events"))
def r10(spark, sf):
    return fetch.task_state(events(spark, sf))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in fetch.STAGE_CHANGES)


@query("r10_illegal_changes", with_ctes(f""", s AS (SELECT *, lag(stage) OVER (PARTITION BY task_id ORDER BY ts_ms, seq) AS previous FROM task_events)
SELECT task_id, previous, stage FROM s WHERE previous IS NOT NULL AND previous <> stage AND (previous, stage) NOT IN ({_ALLOWED})""", "task_events"))
def r10i(spark, sf):
    return fetch.illegal_changes(events(spark, sf)).select("task_id", "previous", "stage")


@query("w13_stage_durations", with_ctes("SELECT task_id, seq, stage, lead(ts_ms) OVER (PARTITION BY task_id ORDER BY ts_ms, seq) - ts_ms AS duration_ms FROM task_events", "task_events"))
def w13(spark, sf):
    return fetch.stage_durations(events(spark, sf)).select("task_id", "seq", "stage", "duration_ms")


@query("r7_progress_samples", with_ctes("""
, p AS (SELECT task_id % 40 AS tab_id, task_id * 16 + segment_index AS pos, bytes, CAST(sum(bytes) OVER (PARTITION BY task_id % 40 ORDER BY task_id * 16 + segment_index) AS BIGINT) AS total_bytes FROM segment_store)
SELECT tab_id, pos, total_bytes FROM p WHERE total_bytes // 8388608 > (total_bytes - bytes) // 8388608""", "segment_store"))
def r7(spark, sf):
    df = store(spark, sf).select((F.col("task_id") % 40).alias("tab_id"), (F.col("task_id") * 16 + F.col("segment_index")).alias("pos"), "bytes")
    return fetch.progress_samples(df, keys=["tab_id"], order=["pos"], width=65_536).select("tab_id", "pos", "total_bytes")


_FILES = "files AS (SELECT task_id, created_ms, protocol || '-' || media_id || '.mp4' AS filename FROM tasks)"


def _files(spark, sf) -> DataFrame:
    return tasks(spark, sf).select("task_id", "created_ms", F.concat("protocol", F.lit("-"), F.col("media_id").cast("string"), F.lit(".mp4")).alias("filename"))


_POLICY = dict(subdir="media/out", order=["created_ms", "task_id"], width=3_600_000)


def _existing(spark, sf) -> DataFrame:
    name = F.concat(F.lit("mediaout/progressive-"), F.col("c_custkey").cast("string"), F.lit(".mp4"))
    return table(spark, sf, "customer").select(name.alias("path"))


@query("s11_plan_outputs_rename", with_ctes(f""", {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_ms, task_id) - 1 + CASE WHEN filename LIKE 'progressive-%' THEN 1 ELSE 0 END AS n FROM files)
SELECT task_id, 'mediaout/' || CASE WHEN n = 0 THEN filename ELSE replace(filename, '.mp4', ' (' || n || ').mp4') END AS path FROM r""", "tasks"))
def s11(spark, sf):
    return fetch.plan_outputs(_files(spark, sf), "rename", existing=_existing(spark, sf), **_POLICY).select("task_id", "path")


@query("s11_plan_outputs_overwrite", with_ctes(f", {_FILES} SELECT arg_max(task_id, created_ms) AS task_id, 'mediaout/' || filename AS path FROM files GROUP BY filename", "tasks"))
def s11o(spark, sf):
    return fetch.plan_outputs(_files(spark, sf), "overwrite", **_POLICY).select("task_id", "path")


@query("s11_plan_outputs_skip", with_ctes(f", {_FILES} SELECT arg_min(task_id, created_ms) AS task_id, 'mediaout/' || filename AS path FROM files WHERE filename NOT LIKE 'progressive-%' GROUP BY filename", "tasks"))
def s11s(spark, sf):
    return fetch.plan_outputs(_files(spark, sf), "skip", existing=_existing(spark, sf), **_POLICY).select("task_id", "path")


@query("a14_failures_by_code", with_ctes(""", f AS (SELECT task_id, segment_index, min(attempt) AS a FROM fetch_attempts
  WHERE attempt <= 3 AND (status_code BETWEEN 200 AND 399 OR status_code IN (401, 403, 404) OR attempt = 3) GROUP BY ALL)
SELECT x.status_code, t.protocol, f.a::BIGINT AS retries, count(*) AS failures FROM f JOIN fetch_attempts x ON x.task_id = f.task_id AND x.segment_index = f.segment_index AND x.attempt = f.a
  LEFT JOIN (SELECT task_id, max(protocol) AS protocol FROM tasks GROUP BY task_id) t ON t.task_id = x.task_id
WHERE NOT x.status_code BETWEEN 200 AND 399 AND x.status_code <> 404 GROUP BY ALL""", "fetch_attempts", "tasks"))
def a14_failures(spark, sf):
    return fetch.failures_by_code(attempts(spark, sf), tasks(spark, sf))


@query("s12_scan_segments", with_ctes("SELECT CAST(task_id AS STRING) AS task_id, segment_index, task_id || '#' || printf('%08d', segment_index) AS segment_key FROM segment_store", "segment_store"))
def s12(spark, sf):
    key = segments.segment_key(F.col("task_id"), F.col("segment_index"))
    files = store(spark, sf).select(F.concat(F.lit("file:/store/"), key, F.lit(".bin")).alias("path"), key.alias("segment_key"))
    return segments.address_segments(files).select("task_id", "segment_index", "segment_key")


@query("f13_merge_feasible", with_ctes("SELECT task_id, total_bytes / 1048576.0 * 1.6 <= (task_id % 3) * 4 * 1024 * 0.25 + CASE WHEN task_id % 3 = 0 THEN 2048 ELSE 0 END AS ok, round(total_bytes / 1048576.0 * 1.6, 6) AS peak_mb, CAST(CASE WHEN task_id % 3 = 0 THEN 2048 ELSE (task_id % 3) * 1024 END AS DOUBLE) AS watermark_mb FROM tasks", "tasks"))
def f13(spark, sf):
    m = media.merge_feasible(F.col("total_bytes") / F.lit(1048576.0), F.col("task_id") % 3 * 4)
    return tasks(spark, sf).select("task_id", m.alias("m")).select("task_id", "m.ok", F.round("m.peak_mb", 6).alias("peak_mb"), "m.watermark_mb")


@query("f15_input_format", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN starts_with(text, 'G') THEN 'ts' ELSE CASE WHEN text = '' THEN 'ts' ELSE 'fmp4' END END WHEN doc_id % 4 = 1 THEN 'ts' WHEN doc_id % 4 = 2 THEN 'fmp4' ELSE 'ts' END AS input_format, CASE WHEN starts_with(text, 'G') OR text = '' THEN 'ts' ELSE 'fmp4' END AS by_bytes FROM documents""")
def f15(spark, sf):
    url = F.element_at(F.array(F.lit(""), F.lit("https://c/x.ts?a"), F.lit("https://c/x.m4s"), F.lit("https://c/x")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", media.input_format(url, F.encode("text", "UTF-8")).alias("input_format"),
                                                      media.input_format(F.lit(""), F.encode("text", "UTF-8")).alias("by_bytes"))


@query("j10_decrypt_segments", """SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'decrypt_failed' WHEN doc_id % 5 = 0 THEN 'clear' ELSE 'decrypted' END AS status, CASE WHEN doc_id % 7 <> 3 THEN text END AS plain_text
FROM (SELECT doc_id, text FROM documents) d""")
def j10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    body = F.encode("text", "UTF-8")
    key = F.unhex(F.md5(F.col("doc_id").cast("string")))
    iv = text.aes_iv(F.when(F.col("doc_id") % 2 == 0, F.md5(F.lit("iv"))), F.col("doc_id"))
    sealed = F.substring(F.aes_encrypt(body, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.lit(2147483647))
    broken = F.encode(F.lit("short"), "UTF-8")
    stored = docs.select("doc_id", F.col("doc_id").alias("segment_index"), F.when(F.col("doc_id") % 7 == 3, broken).when(F.col("doc_id") % 5 == 0, body).otherwise(sealed).alias("content"))
    has_key = (F.col("doc_id") % 5 != 0) | (F.col("doc_id") % 7 == 3)
    keys = docs.select("doc_id", F.when(has_key, key).alias("key"), F.when(F.col("doc_id") % 2 == 0, F.md5(F.lit("iv"))).alias("iv_hex"))
    out = segments.decrypt_segments(stored, keys, by="doc_id")
    return out.select("doc_id", "status", F.decode("plain", "UTF-8").alias("plain_text"))
