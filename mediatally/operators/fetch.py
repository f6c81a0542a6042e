"""Fetch attempts, segment stores and tasks: outcomes, resume, orphans, retries, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediatally.operators.scan import Running, Spans, numbered, running

MAX_RETRY = 3
MAX_MISSING = 2
INACTIVE = ["done", "canceled"]
RESTART_STAGES = ["downloading", "queued", "decrypting", "merging"]
# Fixed value: allowed stage changes of a task.
STAGE_CHANGES = [
    ("queued", "downloading"), ("queued", "canceled"), ("downloading", "paused"), ("paused", "downloading"),
    ("downloading", "decrypting"), ("decrypting", "merging"), ("downloading", "merging"), ("merging", "transcoding"),
    ("merging", "done"), ("transcoding", "done"), ("downloading", "failed"), ("decrypting", "failed"),
    ("merging", "failed"), ("transcoding", "failed"), ("failed", "downloading"), ("failed", "canceled"),
    ("paused", "canceled"),
]


def failures_by_code(attempts: DataFrame, tasks: DataFrame, max_retry: int = MAX_RETRY) -> DataFrame:
    """Failed segments by status code, protocol and number of retries. A task that is not listed has no protocol."""
    failed = _decided(attempts, max_retry).filter("outcome = 'failed'").select("task_id", "status_code", (F.col("attempts") - 1).alias("retries"))
    known = tasks.groupBy("task_id").agg(F.max("protocol").alias("protocol"))
    return failed.join(known, "task_id", "left").groupBy("status_code", "protocol", "retries").agg(F.count(F.lit(1)).alias("failures"))


def fetch_outcomes(attempts: DataFrame, max_retry: int = MAX_RETRY) -> DataFrame:
    """A5: per segment its outcome, see `_decided`. Attempts may carry `error`; then the outcome tells whether it was `decrypt`."""
    return _decided(attempts, max_retry).drop("status_code")


def _decided(attempts: DataFrame, max_retry: int) -> DataFrame:
    """Per segment the first deciding attempt: 200 completes, 404 is missing, 401/403 fails on credentials,
    any other answer is retried until more than `max_retry` attempts failed. Attempts after it do not count. With a column
    `error`, a segment that could not be opened (`decrypt_failed`) has failed, whatever its answer.
    """
    status = F.col("status_code")
    told = "error" in attempts.columns
    unopened = F.coalesce(F.col("error") == "decrypt_failed", F.lit(False)) if told else F.lit(False)
    attempts = attempts.withColumn("_unopened", unopened)
    final = F.col("_unopened") | status.between(200, 399) | status.isin(401, 403, 404) | (F.col("attempt") >= max_retry)
    within = attempts.filter(F.col("attempt") <= max_retry)
    # values of fixed width only: such aggregates are kept in place, other ones sort every attempt
    at = F.when(final, F.col("attempt"))
    decided = within.groupBy("task_id", "segment_index").agg(
        F.min(at).alias("first"), F.min_by("status_code", at).alias("code"), F.min_by("bytes", at).alias("_bytes"),
        *([F.min_by("_unopened", at).alias("unopened")] if told else []), F.max("attempt").alias("last_attempt"),
        # throttled answers by attempt, to count those up to the deciding one
        *[F.count_if(status.isin(429, 503) & (F.col("attempt") == n)).alias(f"_throttled_{n}") for n in range(max_retry + 1)],
    )
    code = F.col("code")
    unopened = F.coalesce(F.col("unopened"), F.lit(False)) if told else F.lit(False)
    outcome = (
        F.when(F.col("first").isNull(), F.lit("pending"))
        .when(unopened, F.lit("failed"))
        .when(code.between(200, 399), F.lit("completed"))
        .when(code == 404, F.lit("missing"))
        .otherwise(F.lit("failed"))
    )
    upto = F.coalesce(F.col("first"), F.col("last_attempt"))
    throttled = sum((F.when(upto >= n, F.col(f"_throttled_{n}")).otherwise(F.lit(0)) for n in range(max_retry + 1)), F.lit(0))
    return decided.select(
        "task_id", "segment_index", outcome.alias("outcome"), (upto + 1).cast("bigint").alias("attempts"),
        (F.coalesce(code.isin(401, 403), F.lit(False)) & ~unopened).alias("credential"),
        *([unopened.alias("decrypt")] if told else []), throttled.cast("bigint").alias("throttled"),
        F.when(outcome == "completed", F.col("_bytes")).alias("bytes"), code.alias("status_code"),
    )


def task_outcomes(outcomes: DataFrame, max_missing: int = MAX_MISSING, concurrency: int = 4, expected: DataFrame | None = None,
                  canceled: DataFrame | None = None) -> DataFrame:
    """Per task the outcome counts, abort reason and suggested concurrency. The segment lists stay rows of A5 and
    `aborted_segments`.

    The reason is the first of credential, decrypt (if the outcomes tell), missing (more than `max_missing`) and canceled (tasks in
    `canceled`). With `expected` (task_id, segment_index), segments that were never decided count as `aborted`, and as failed too
    when the task stopped for another reason than missing segments; tasks without any attempt are listed then.
    """
    counted = ["completed", "failed", "missing"]
    flags = ["credential", *(["decrypt"] if "decrypt" in outcomes.columns else [])]
    rows = outcomes.select("task_id", "outcome", "throttled", *flags)
    if expected is not None:
        rows = rows.unionByName(aborted_segments(expected, outcomes).select("task_id", F.lit("aborted").alias("outcome")), allowMissingColumns=True)
        counted.append("aborted")
    counts = rows.groupBy("task_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in counted], F.coalesce(F.sum("throttled"), F.lit(0)).alias("throttled"),
        *[F.coalesce(F.max(f), F.lit(False)).alias(f"_{f}") for f in flags])
    if canceled is not None:
        counts = counts.join(canceled.select("task_id").distinct().withColumn("_canceled", F.lit(True)), "task_id", "left")
        flags.append("canceled")
    reason = F.when(F.col("_credential"), F.lit("credential"))
    if "decrypt" in flags:
        reason = reason.when(F.col("_decrypt"), F.lit("decrypt"))
    reason = reason.when(F.col("missing") > max_missing, F.lit("missing"))
    if "canceled" in flags:
        reason = reason.when(F.col("_canceled"), F.lit("canceled"))
    counts = counts.withColumn("abort_reason", reason)
    failed = F.col("failed")
    if expected is not None:
        failed = failed + F.when(F.col("abort_reason") != "missing", F.col("aborted")).otherwise(F.lit(0))
    slower = F.when((F.col("throttled") > 2) & F.lit(concurrency > 1), F.lit(max(1, concurrency - 1))).otherwise(F.lit(concurrency))
    return counts.select("task_id", "completed", failed.alias("failed"), *[c for c in counted if c not in ("completed", "failed")], "throttled",
                         "abort_reason", slower.cast("bigint").alias("suggested_concurrency"))


def aborted_segments(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Expected segments (task_id, segment_index) that no attempt has decided."""
    decided = outcomes.filter("outcome <> 'pending'").select("task_id", "segment_index")
    return expected.join(decided, ["task_id", "segment_index"], "left_anti")


def backoff_schedule(attempts: DataFrame, *, base_ms: int = 500, cap_ms: int = 8000, max_retry: int = MAX_RETRY) -> DataFrame:
    """Wait after each failed attempt and the total so far. Throttled answers wait the cap.

    A segment has at most `max_retry` retries, so its window is small whatever the task holds.
    """
    n = F.col("attempt")
    retried = (n < max_retry) & ~F.col("status_code").between(200, 399) & ~F.col("status_code").isin(401, 403, 404)
    wait = F.when(F.col("status_code").isin(429, 503), F.lit(cap_ms)).otherwise(
        F.least(F.lit(base_ms) * F.pow(F.lit(2), n), F.lit(cap_ms)))
    waits = attempts.filter(retried).withColumn("wait_ms", wait.cast("bigint"))
    w = Window.partitionBy("task_id", "segment_index").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return waits.withColumn("total_wait_ms", F.sum("wait_ms").over(w))


def dedup_tasks(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tasks split into accepted and duplicate; a duplicate's media has a task that is neither done nor canceled."""
    open_media = existing.filter(~F.col("stage").isin(INACTIVE)).select("media_id").distinct()
    return new.join(open_media, "media_id", "left_anti"), new.join(open_media, "media_id", "left_semi")


def orphan_segments(store: DataFrame, alive: DataFrame) -> DataFrame:
    """Stored segments whose task is gone."""
    return store.join(alive.select("task_id").distinct(), "task_id", "left_anti")


def resume_todo(expected: DataFrame, completed: DataFrame) -> DataFrame:
    """Expected segments not fetched yet."""
    return expected.join(completed, ["task_id", "segment_index"], "left_anti")


def expand_expected(plan: DataFrame) -> DataFrame:
    """Rows (task_id, segment_index) from per-task segment counts."""
    return plan.filter("segment_count > 0").select(
        "task_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segment_count").cast("bigint") - 1)).alias("segment_index"))


def missing_segments(expected: DataFrame, store: DataFrame, max_missing: int = MAX_MISSING) -> DataFrame:
    """Per task expected, present and missing counts and whether merging may go on.

    Both tables are sorted once together and met in a window over the segment, which holds one segment at a time.
    """
    rows = expected.select("task_id", "segment_index", F.lit(False).alias("_stored")).unionAll(
        store.select("task_id", "segment_index", F.lit(True).alias("_stored")))
    # NULL is no segment: such an expected one is never there
    have = F.max("_stored").over(Window.partitionBy("task_id", "segment_index")) & F.col("task_id").isNotNull() & F.col("segment_index").isNotNull()
    met = rows.withColumn("_have", have).filter(~F.col("_stored"))
    counts = met.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("_have").alias("present"),
        F.min(F.when(~F.col("_have"), F.col("segment_index"))).alias("first_missing"))
    gap = F.col("expected") - F.col("present")
    return counts.select("task_id", "expected", "present", gap.alias("missing"), "first_missing",
                         F.when(gap <= max_missing, F.lit("continue")).otherwise(F.lit("abort")).alias("decision"))


def merge_completed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct union of completed segment rows."""
    return old.select("task_id", "segment_index").union(new.select("task_id", "segment_index")).distinct()


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of `a` that are not in `b`."""
    return a.subtract(b)


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: distinct rows in both."""
    return a.intersect(b)


def ordered_segments(store: DataFrame) -> DataFrame:
    """Present segments in index order per task; a range-partitioned sort splits large tasks."""
    return store.orderBy("task_id", "segment_index")


def select_variant(choices: DataFrame, variants: DataFrame, *, item: str = "item_id") -> DataFrame:
    """The chosen variant, else the first (lowest rank). `choices`: item, variant_id or NULL. `variants`: item, variant_id, rank."""
    defaults = variants.groupBy(item).agg(F.min_by("variant_id", "rank").alias("_default"))
    listed = variants.select(item, "variant_id").distinct().withColumn("_known", F.lit(True))
    picked = choices.join(listed, [item, "variant_id"], "left").join(defaults, item, "left")
    return picked.select(*choices.columns, F.when(F.col("_known"), F.col("variant_id")).otherwise(F.col("_default")).alias("selected_id"))


def join_live_or_snapshot(tasks: DataFrame, live: DataFrame, snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    """Where a task's media comes from: the live item, the frozen snapshot, a shell for kept segments, or nowhere.

    `live`: media_id, tab_id, title. `snapshots`: task_id, title. `kept`: task_id of tasks with stored segments.
    """
    l = live.select("media_id", "tab_id", F.col("title").alias("_live"))
    s = snapshots.select("task_id", F.col("title").alias("_snap"))
    k = kept.select("task_id").distinct().withColumn("_kept", F.lit(True))
    joined = tasks.join(l, ["media_id", "tab_id"], "left").join(s, "task_id", "left").join(k, "task_id", "left")
    source = (
        F.when(F.col("_live").isNotNull(), F.lit("live")).when(F.col("_snap").isNotNull(), F.lit("snapshot"))
        .when(F.col("_kept"), F.lit("shell")).otherwise(F.lit("media_gone"))
    )
    return joined.select("task_id", "media_id", "tab_id", source.alias("media_source"),
                         F.coalesce("_live", "_snap").alias("title"))


def task_rollup(outcomes: DataFrame, audio: Column) -> DataFrame:
    """Per task bytes, completed of total, and the same per track; `audio` tells a segment's track."""
    done = F.col("outcome") == "completed"
    return outcomes.groupBy("task_id").agg(
        F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(done).alias("completed_segments"), F.count(F.lit(1)).alias("total_segments"),
        F.count_if(done & ~audio).alias("video_completed"), F.count_if(~audio).alias("video_total"),
        F.count_if(done & audio).alias("audio_completed"), F.count_if(audio).alias("audio_total"))


def task_panel(tasks: DataFrame) -> DataFrame:
    """Number of tasks per panel group; canceled tasks are in none."""
    group = (
        F.when(F.col("stage").isin("queued", "downloading", "decrypting", "merging", "transcoding"), F.lit("active"))
        .when(F.col("stage") == "done", F.lit("done")).when(F.col("stage").isin("failed", "paused"), F.lit("failed"))
    )
    return tasks.withColumn("panel", group).filter("panel IS NOT NULL").groupBy("panel").agg(F.count(F.lit(1)).alias("tasks"))


def restore_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that were under way when the host restarted become paused."""
    hit = F.col("stage").isin(RESTART_STAGES)
    return tasks.withColumns({
        "error_message": F.when(hit, F.lit("interrupted")),
        "stage": F.when(hit, F.lit("paused")).otherwise(F.col("stage")),
    })


def task_state(events: DataFrame) -> DataFrame:
    """Current stage of every task."""
    return events.groupBy("task_id").agg(
        F.max_by("stage", F.struct("ts_ms", "seq")).alias("stage"), F.max("ts_ms").alias("updated_ms"))


def illegal_changes(events: DataFrame, width: int = 3_600_000) -> DataFrame:
    """Stage changes the state diagram does not have."""
    stepped = running(events, keys=["task_id"], order=["ts_ms", "seq"], bucket=Spans("ts_ms", width),
                      previous=Running("last", F.col("stage"), exclusive=True))
    pair = F.concat_ws(">", "previous", "stage")
    allowed = [f"{a}>{b}" for a, b in STAGE_CHANGES]
    return stepped.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("stage")) & ~pair.isin(allowed))


def stage_durations(events: DataFrame, width: int = 3_600_000) -> DataFrame:
    """Time from each stage to the next, NULL for the current one."""
    stepped = running(events, keys=["task_id"], order=["ts_ms", "seq"], bucket=Spans("ts_ms", width),
                      next_ms=Running("next", F.col("ts_ms")))
    return stepped.withColumn("duration_ms", F.col("next_ms") - F.col("ts_ms")).drop("next_ms")


def progress_samples(attempts: DataFrame, *, keys: list[str], order: list[str], width: int, step: int = 8 * 1024 * 1024) -> DataFrame:
    """R7 in batch: rows at which a task's running bytes cross a multiple of `step`."""
    scanned = running(attempts, keys=keys, order=order, bucket=Spans(order[0], width),
                      total_bytes=Running("sum", F.col("bytes")))
    crossed = F.floor(F.col("total_bytes") / step) > F.floor((F.col("total_bytes") - F.col("bytes")) / step)
    return scanned.filter(crossed)


def latest_tasks(tasks: DataFrame, n: int = 50) -> DataFrame:
    """T5: the newest tasks."""
    return tasks.orderBy(F.desc("created_ms"), F.desc("task_id")).limit(n)


def plan_outputs(tasks: DataFrame, policy: str = "rename", subdir: str = "", existing: DataFrame | None = None,
                 *, order: list[str], width: int) -> DataFrame:
    """Target path per task. `rename` numbers repeats ` (n)`, `overwrite` keeps the latest per path,
    `skip` drops every task whose path is taken, by an existing file or an earlier task.
    """
    folder = subdir.replace("/", "").replace("\\", "")
    path = F.concat(F.lit(f"{folder}/"), F.col("filename")) if folder else F.col("filename")
    df = tasks.withColumn("path", path)
    if policy == "overwrite":
        latest = F.max_by(F.struct(*tasks.columns), F.struct(*order)).alias("_l")
        return df.groupBy("path").agg(latest).select("_l.*", "path")
    taken = existing.select("path").distinct() if existing is not None else None
    if policy == "skip":
        earliest = F.min_by(F.struct(*tasks.columns), F.struct(*order)).alias("_f")
        kept = df.groupBy("path").agg(earliest).select("_f.*", "path")
        return kept.join(taken, "path", "left_anti").select(*tasks.columns, "path") if taken is not None else kept
    if policy != "rename":
        raise ValueError(f"unknown policy {policy}")
    ranked = numbered(df, keys=["path"], order=order, bucket=Spans(order[0], width), name="_n")
    shift = F.lit(0)
    if taken is not None:
        ranked = ranked.join(taken.withColumn("_taken", F.lit(1)), "path", "left")
        shift = F.coalesce("_taken", F.lit(0))
    n = F.col("_n") - 1 + shift
    stem, ext = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    final = F.when(n > 0, F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)).otherwise(F.col("path"))
    return ranked.withColumn("path", final).select(*tasks.columns, "path")
