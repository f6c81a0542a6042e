"""Attempts, tasks, outputs."""

from pyspark.sql import functions as F

from mediatally.operators import fetch


def attempts(spark, *rows):
    return spark.createDataFrame([(1, s, a, c, 10) for s, a, c in rows], "task_id bigint, segment_index bigint, attempt int, status_code int, bytes bigint")


def test_outcomes(spark):
    df = attempts(spark, (1, 0, 0), (1, 1, 503), (1, 2, 200), (1, 3, 503), (2, 0, 404), (2, 1, 200), (3, 0, 401), (4, 0, 0), (4, 1, 0), (4, 2, 0), (4, 3, 429), (5, 0, 0))
    got = {r.segment_index: (r.outcome, r.attempts, r.credential, r.throttled, r.bytes) for r in fetch.fetch_outcomes(df).collect()}
    assert got == {1: ("completed", 3, False, 1, 10), 2: ("missing", 1, False, 0, None), 3: ("failed", 1, True, 0, None), 4: ("failed", 4, False, 1, None), 5: ("pending", 1, False, 0, None)}


def test_task_outcomes(spark):
    missing = lambda n: fetch.task_outcomes(fetch.fetch_outcomes(attempts(spark, *[(i, 0, 404) for i in range(n)], (99, 0, 200)))).first()
    assert missing(2).abort_reason is None and missing(3).abort_reason == "missing"
    assert fetch.task_outcomes(fetch.fetch_outcomes(attempts(spark, (1, 0, 401)))).first().abort_reason == "credential"
    slow = fetch.task_outcomes(fetch.fetch_outcomes(attempts(spark, (1, 0, 503), (1, 1, 503), (1, 2, 503), (1, 3, 200)))).first()
    assert (slow.throttled, slow.suggested_concurrency) == (3, 3)


def test_backoff(spark):
    df = fetch.backoff_schedule(attempts(spark, (1, 0, 0), (1, 1, 0), (1, 2, 200), (2, 0, 503), (2, 1, 500)))
    got = {(r.segment_index, r.attempt): (r.wait_ms, r.total_wait_ms) for r in df.collect()}
    assert got == {(1, 0): (500, 500), (1, 1): (1000, 1500), (2, 0): (8000, 8000), (2, 1): (1000, 9000)}


def test_resume_missing_orphans(spark):
    plan = spark.createDataFrame([(1, 4), (2, 3), (3, 0)], "task_id bigint, segment_count bigint")
    expected = fetch.expand_expected(plan)
    store = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (9, 0)], "task_id bigint, segment_index bigint")
    assert sorted(map(tuple, fetch.resume_todo(expected, store).collect())) == [(1, 1), (1, 3), (2, 0), (2, 1), (2, 2)]
    got = {r.task_id: tuple(r)[1:] for r in fetch.missing_segments(expected, store).collect()}
    assert got == {1: (4, 2, 2, 1, "continue"), 2: (3, 0, 3, 0, "abort")}
    assert [r.task_id for r in fetch.orphan_segments(store, plan).collect()] == [9]
    assert sorted(r.segment_index for r in fetch.merge_completed(store.filter("task_id = 1"), store.filter("task_id = 9")).collect()) == [0, 0, 2]


def test_duplicate_tasks(spark):
    old = spark.createDataFrame([(1, "done"), (2, "failed"), (3, "canceled"), (2, "paused")], "media_id bigint, stage string")
    accepted, duplicate = fetch.dedup_tasks(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "media_id bigint"), old)
    assert sorted(r.media_id for r in accepted.collect()) == [1, 3, 4] and [r.media_id for r in duplicate.collect()] == [2]


def test_select_variant(spark):
    variants = spark.createDataFrame([(1, "hi", 1), (1, "lo", 2)], "item_id bigint, variant_id string, rank int")
    choices = spark.createDataFrame([(1, "lo"), (1, None), (1, "gone"), (2, "lo")], "item_id bigint, variant_id string")
    got = {(r.item_id, r.variant_id): r.selected_id for r in fetch.select_variant(choices, variants).collect()}
    assert got == {(1, "lo"): "lo", (1, None): "hi", (1, "gone"): "hi", (2, "lo"): None}


def test_states(spark):
    ev = spark.createDataFrame([(1, 0, 0, "queued"), (1, 1, 10, "downloading"), (1, 2, 30, "merging"), (1, 3, 31, "downloading")], "task_id bigint, seq bigint, ts_ms bigint, stage string")
    assert fetch.task_state(ev).first().stage == "downloading"
    assert [(r.previous, r.stage) for r in fetch.illegal_changes(ev, width=4).collect()] == [("merging", "downloading")]
    assert [r.duration_ms for r in fetch.stage_durations(ev, width=4).orderBy("seq").collect()] == [10, 20, 1, None]
    back = fetch.restore_tasks(ev.select("task_id", "stage").distinct()).collect()
    assert {r.stage for r in back} == {"paused"}


def test_outputs(spark):
    rows = [(1, 1, "a.mp4"), (2, 2, "a.mp4"), (3, 5000, "a.mp4"), (4, 4, "b.tar.gz"), (5, 5, "noext"), (6, 6, "noext")]
    df = spark.createDataFrame(rows, "task_id bigint, created_ms bigint, filename string")
    args = dict(order=["created_ms", "task_id"], width=10)
    paths = lambda d: {r.task_id: r.path for r in d.collect()}
    assert paths(fetch.plan_outputs(df, "rename", "s/u\\b", **args)) == {
        1: "sub/a.mp4", 2: "sub/a (1).mp4", 3: "sub/a (2).mp4", 4: "sub/b.tar.gz", 5: "sub/noext", 6: "sub/noext (1)"}
    taken = spark.createDataFrame([("a.mp4",)], "path string")
    assert paths(fetch.plan_outputs(df, "rename", "", taken, **args))[1] == "a (1).mp4"
    assert set(paths(fetch.plan_outputs(df, "overwrite", "", **args))) == {3, 4, 6}
    assert set(paths(fetch.plan_outputs(df, "skip", "", taken, **args))) == {4, 5}


def test_progress(spark):
    df = spark.createDataFrame([("t", i, 3) for i in range(10)], "k string, pos bigint, bytes bigint")
    got = fetch.progress_samples(df, keys=["k"], order=["pos"], width=4, step=8)
    assert sorted(r.total_bytes for r in got.collect()) == [9, 18, 24]


def test_media_source(spark):
    tasks = spark.createDataFrame([(i, i, 1) for i in (1, 2, 3, 4)], "task_id bigint, media_id bigint, tab_id bigint")
    live = spark.createDataFrame([(1, 1, "live")], "media_id bigint, tab_id bigint, title string")
    snaps = spark.createDataFrame([(1, "old"), (2, "old")], "task_id bigint, title string")
    kept = spark.createDataFrame([(3,), (3,)], "task_id bigint")
    got = {r.task_id: (r.media_source, r.title) for r in fetch.join_live_or_snapshot(tasks, live, snaps, kept).collect()}
    assert got == {1: ("live", "live"), 2: ("snapshot", "old"), 3: ("shell", None), 4: ("media_gone", None)}


def test_reasons_and_aborted_segments(spark):
    tried = spark.createDataFrame(
        [(1, 0, 0, 200, 5, None), (1, 1, 0, 200, 5, "decrypt_failed"), (2, 0, 0, 401, 0, None), (2, 1, 0, 200, 5, "decrypt_failed"),
         (3, 0, 0, 404, 0, None), (3, 1, 0, 404, 0, None), (3, 2, 0, 404, 0, None), (4, 0, 0, 200, 5, None), (5, 0, 0, 500, 0, None)],
        "task_id bigint, segment_index bigint, attempt bigint, status_code int, bytes bigint, error string")
    expected = spark.createDataFrame([(t, s) for t in range(1, 7) for s in range(4)], "task_id bigint, segment_index bigint")
    canceled = spark.createDataFrame([(3,), (4,), (4,), (6,)], "task_id bigint")
    outcomes = fetch.fetch_outcomes(tried)
    got = {r.task_id: (r.completed, r.failed, r.missing, r.aborted, r.abort_reason) for r in fetch.task_outcomes(outcomes, expected=expected, canceled=canceled).collect()}
    assert got == {1: (1, 3, 0, 2, "decrypt"), 2: (0, 4, 0, 2, "credential"), 3: (0, 0, 3, 1, "missing"), 4: (1, 3, 0, 3, "canceled"),
                   5: (0, 0, 0, 4, None), 6: (0, 4, 0, 4, "canceled")}
    assert fetch.aborted_segments(expected, outcomes).filter("task_id = 5").count() == 4
