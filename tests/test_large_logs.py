"""Cases that only longer logs and larger tables show."""

from mediatally.operators import fetch
from mediatally.session import scratch_dir
from mediatally.streaming import requests as streams, run

from conftest import plan_of

T0 = 1_700_000_000_000
MINUTE = 60_000


def _pending(spark, segments, manifests):
    """Pairs that `stream_pending_segments` gives for (tab, minute, url) rows with a wait of ten minutes."""
    sides = []
    for rows in (segments, manifests):
        folder = scratch_dir(spark, "pending")
        df = spark.createDataFrame([(t, T0 + int(m * MINUTE), u) for t, m, u in rows], "tab_id bigint, ts_ms bigint, url string").coalesce(1)
        df.write.parquet(folder)
        sides.append(run.closable(spark.readStream.schema(df.schema).parquet(folder), tab_id=-1, url="https://end.invalid/"))
    (s, close_s), (m, close_m) = sides
    out = run.drain(streams.stream_pending_segments(s, m), "pending-pairs", close=lambda: (close_s(), close_m()))
    return {(r.tab_id, r.dir, r.dedup_key, (r.segment_ms - T0) / MINUTE, (r.manifest_ms - T0) / MINUTE) for r in out.collect()}


def test_pending_segments_meet_at_any_repeat(spark):
    # the first repeats lie far apart, later ones do not; tab 2 is just too late, tab 3 just in time across slots
    segments = [(1, 0, "https://h.com/a/b/1.ts"), (1, 300, "https://h.com/a/b/2.ts"), (2, 0, "https://h.com/a/b/1.ts"),
                (3, 0, "https://h.com/a/b/1.ts"), (3, 9, "https://h.com/a/b/2.ts")]
    manifests = [(1, 305, "https://h.com/a/m.mpd"), (2, 10.5, "https://h.com/a/m.mpd"), (3, 19, "https://h.com/a/m.mpd")]
    got = _pending(spark, segments, manifests)
    assert {g[:3] for g in got} == {(t, "https://h.com/a/b/", "https://h.com/a/m.mpd") for t in (1, 3)}
    assert all(abs(s - m) <= 10 for *_, s, m in got)


def test_deciding_attempts_are_kept_in_place(spark):
    rows = [(1, 0, 0, 503, 5, None), (1, 0, 1, 429, 5, None), (1, 0, 2, 200, 7, None), (1, 0, 3, 503, 9, None),  # throttled after it: not counted
            (2, 0, 0, 503, 5, None), (2, 0, 1, 0, 5, None), (3, 0, 0, 200, 5, "decrypt_failed"), (4, 0, 0, 200, None, None)]
    df = spark.createDataFrame(rows, "task_id bigint, segment_index bigint, attempt int, status_code int, bytes bigint, error string")
    out = fetch.fetch_outcomes(df)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 0, "completed", 3, False, False, 2, 7), (2, 0, "pending", 2, False, False, 1, None),
        (3, 0, "failed", 1, False, True, 0, None), (4, 0, "completed", 1, False, False, 0, None)]
    plan = plan_of(out)
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
