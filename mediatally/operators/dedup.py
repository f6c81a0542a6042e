"""Time-window dedup, page loads, page context, state age."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mediatally.functions import urls
from mediatally.operators.scan import HOUR_MS, Running, Spans, every, running

WINDOW_MS = 60_000


def navigation_epoch(df: DataFrame, *, partition: list[str] | None = None, order: str = "ts_ms",
                     tie: str = "request_id", width: int = HOUR_MS) -> DataFrame:
    """`epoch` counts the page loads of a tab up to each row; a load starts the epoch it belongs to."""
    is_nav = F.when(F.col("kind") == "nav", 1)
    return running(df, keys=partition or ["tab_id"], order=[order, tie], bucket=Spans(order, width),
                   epoch=Running("count", is_nav))


def page_context_asof(df: DataFrame, *, order: str = "ts_ms", tie: str = "request_id", width: int = HOUR_MS) -> DataFrame:
    """Host of the page the tab showed at the time of each request, NULL before its first page load."""
    nav_host = F.when(F.col("kind") == "nav", urls.host_of(F.col("url")))
    return running(df, keys=["tab_id"], order=[order, tie], bucket=Spans(order, width),
                   page_host=Running("last", nav_host))


def live_states(df: DataFrame, now_ms: Column, ttl_ms: int = 12 * HOUR_MS) -> DataFrame:
    """R5 in batch: states saved within the last twelve hours."""
    return df.filter(F.col("saved_ms").isNotNull() & (now_ms - F.col("saved_ms") <= ttl_ms))


def _greedy(times: Column, last_kept: Column, window_ms: int) -> Column:
    """Kept times of a sorted array, given the last time kept before it (NULL for none)."""
    start = F.struct(last_kept.cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    return F.aggregate(
        times, start,
        lambda acc, t: F.when(
            acc["last"].isNull() | (t - acc["last"] >= window_ms),
            F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


# A stretch of a key's time without an inner gap as a step function: kept first at or before `upto`
# (and after the step before), it keeps `end` last. Steps lie in time order.
_STEPS = "array<struct<upto:bigint,end:bigint>>"


def _steps(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    keep = np.append(ends[1:] != ends[:-1], True)
    return [{"upto": int(u), "end": int(e)} for u, e in zip(starts[keep], ends[keep])]


def _chunk_steps(window_ms: int):
    """Batches of chunks (`times`) to their step functions."""

    def run(batches):
        for pdf in batches:
            out = []
            for times in pdf["times"]:
                a = np.asarray(times, dtype=np.int64)
                nxt = np.searchsorted(a, a + window_ms, side="left")
                last = np.where(nxt < len(a), nxt, np.arange(len(a)))
                while not np.array_equal(last[last], last):
                    last = last[last]
                # a first kept time lies within one window of the chunk's first time, or is the next one
                n = min(int(np.searchsorted(a, a[0] + window_ms, side="left")) + 1, len(a))
                out.append(_steps(a[:n], a[last[:n]]))
            yield pdf.drop(columns="times").assign(steps=out)

    return run


def _span_steps(window_ms: int):
    """Batches of spans (`cs`, several chunks without a gap) to the composed step functions."""

    def run(batches):
        for pdf in batches:
            out = []
            for cs in pdf["cs"]:
                chunks = [(c["_first"], c["_latest"], np.array([s["upto"] for s in c["steps"]], dtype=np.int64),
                           np.array([s["end"] for s in c["steps"]], dtype=np.int64)) for c in cs]
                starts, ends = [], []
                for j, (_, _, upto, end) in enumerate(chunks):
                    if j and chunks[j - 1][1] >= chunks[0][0] + window_ms:
                        break
                    for _, _, u, e in chunks[j + 1:]:
                        at = np.searchsorted(u, end + window_ms, side="left")
                        end = np.where(at < len(u), e[np.minimum(at, len(u) - 1)], end)
                    starts.append(upto)
                    ends.append(end)
                out.append(_steps(np.concatenate(starts), np.concatenate(ends)))
            yield pdf.drop(columns="cs").assign(steps=out)

    return run


def _map_steps(df: DataFrame, fn, payload: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != payload)
    return df.mapInPandas(fn, f"{schema}, steps {_STEPS}")


def _follow(end: Column, steps: Column, last: Column, window_ms: int) -> Column:
    """Last kept time after a stretch: its fixed end, or its step for the last time kept before it."""
    hit = F.get(F.filter(steps, lambda s: last.isNull() | (s["upto"] >= last + window_ms)), F.lit(0))["end"]
    return F.coalesce(end, hit, last)


def _entries(stretches: Column, last: Column, name: str, window_ms: int) -> Column:
    """For an array of stretches in order, the last time kept before each, as structs (`name`, _entry)."""
    start = F.struct(last.cast("bigint").alias("last"), F.array().cast(f"array<struct<{name}:bigint,_entry:bigint>>").alias("seen"))
    return F.aggregate(
        stretches, start,
        lambda acc, c: F.struct(
            _follow(c["_end"], c["steps"], acc["last"], window_ms).alias("last"),
            F.concat(acc["seen"], F.array(F.struct(c[name].alias(name), acc["last"].alias("_entry")))).alias("seen")),
        lambda acc: acc["seen"],
    )


def _chunk_states(chunks: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Per chunk its first and last time and how it ends: `_end` when an inner gap fixes that, else `steps`;
    `_fresh` is the end when nothing was kept shortly before it."""
    times = F.col("times")
    # position after the last inner gap, 0 when the chunk has none
    after_gap = F.aggregate(
        times,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("cut"), F.lit(None).cast("bigint").alias("prev")),
        lambda acc, t: F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(t - acc["prev"] >= window_ms, acc["i"]).otherwise(acc["cut"]).alias("cut"),
            t.alias("prev"),
        ),
        lambda acc: acc["cut"],
    )
    measured = chunks.select(*keys, "_chunk", "times", after_gap.alias("_cut"),
                             F.element_at("times", 1).alias("_first"), F.element_at("times", -1).alias("_latest"))
    long = (F.col("_cut") == 0) & (F.col("_latest") - F.col("_first") >= window_ms)
    tail = F.slice("times", F.col("_cut") + 1, F.size("times"))
    settled = F.when(F.col("_cut") > 0, F.element_at(_greedy(tail, F.lit(None), window_ms), -1))
    # shorter than the window: whatever is kept first is also kept last
    short = F.when(F.col("_cut") == 0, F.transform("times", lambda t: F.struct(t.alias("upto"), t.alias("end"))))
    columns = [*keys, "_chunk", "_first", "_latest"]
    plain = measured.filter(~long).select(*columns, settled.alias("_end"), short.alias("steps"))
    stepped = _map_steps(measured.filter(long).select(*columns, "times"), _chunk_steps(window_ms), "times")
    states = plain.unionByName(stepped.withColumn("_end", F.lit(None).cast("bigint")))
    return states.withColumn("_fresh", F.coalesce("_end", F.get("steps", F.lit(0))["end"]))


def _span_states(spans: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Per span of chunks (`cs`) its fixed end, or its step function when it has no gap anywhere."""
    fixed = F.aggregate(
        "cs",
        F.struct(F.lit(False).alias("known"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("prev")),
        lambda acc, c: F.struct(
            (acc["known"] | c["_end"].isNotNull() | F.coalesce(c["_first"] - acc["prev"] >= window_ms, F.lit(False))).alias("known"),
            F.when(c["_first"] - acc["prev"] >= window_ms, c["_fresh"])
            .otherwise(_follow(c["_end"], c["steps"], acc["last"], window_ms)).alias("last"),
            c["_latest"].alias("prev")),
        lambda acc: F.when(acc["known"], acc["last"]),
    )
    ended = spans.select(*keys, "_span", "cs", fixed.alias("_end"))
    joined = F.col("_end").isNull() & (F.size("cs") > 1)
    single = F.when(F.col("_end").isNull(), F.get("cs", F.lit(0))["steps"])
    plain = ended.filter(~joined).select(*keys, "_span", "_end", single.alias("steps"))
    composed = _map_steps(ended.filter(joined).select(*keys, "_span", "cs"), _span_steps(window_ms), "cs")
    return plain.unionByName(composed.withColumn("_end", F.lit(None).cast("bigint")))


def dedup_window(df: DataFrame, *, keys: list[str], order: str = "ts_ms", tie: str = "request_id",
                 window_ms: int = WINDOW_MS, chunk_ms: int = HOUR_MS, span_chunks: int = 64) -> DataFrame:
    """Per key, keep a row only when at least `window_ms` passed since the last kept row.

    The rule is sequential, but a gap of `window_ms` makes it start anew. Each key's distinct times are
    collected per chunk of event time, so an array is bounded by the chunk's length however many rows a
    key has. A chunk with an inner gap ends in one way; a chunk without is summed up as a step function
    from its possible first kept times to its last one. Chunks are combined per span of chunks in the
    same form, and only one such state per span is chained per key. The way back is parallel again:
    spans hand their entry to their chunks, and every chunk is resolved on its own.
    NULL is a key like any other. Rows without a time can't be placed and are all kept.
    """
    columns, untimed = df.columns, df.filter(F.col(order).isNull())
    # structs are equal where both have NULL
    key = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keys])
    rows = df.filter(F.col(order).isNotNull()).withColumns({"_key": key, "_chunk": every(order, chunk_ms)})
    keys = ["_key"]
    chunks = rows.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_set(order)).alias("times"))
    state = F.struct("_chunk", "_first", "_latest", "_fresh", "_end", "steps")
    spans = (
        _chunk_states(chunks, keys, window_ms).withColumn("_span", every("_chunk", span_chunks))
        .groupBy(*keys, "_span").agg(F.array_sort(F.collect_list(state)).alias("cs")))
    per_key = _span_states(spans, keys, window_ms).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_span", "_end", "steps"))).alias("ss"))
    span_entries = per_key.select(*keys, F.inline(_entries(F.col("ss"), F.lit(None), "_span", window_ms)))
    chunk_entries = spans.join(span_entries, [*keys, "_span"]).select(
        *keys, F.inline(_entries(F.col("cs"), F.col("_entry"), "_chunk", window_ms)))
    kept_times = chunks.join(chunk_entries, [*keys, "_chunk"]).select(
        *keys, "_chunk", F.explode(_greedy(F.col("times"), F.col("_entry"), window_ms)).alias(order))
    at_kept = rows.join(kept_times, [*keys, "_chunk", order], "left_semi")
    # of several rows at one kept time the first counts
    winner = F.min_by(F.struct(*columns), F.col(tie)).alias("_row")
    return at_kept.groupBy(*keys, "_chunk", order).agg(winner).select("_row.*").unionByName(untimed)


def dedup_requests(df: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """W1 on requests: one row per tab and URL without its query within a minute."""
    keyed = df.withColumn("url_base", urls.without_query(F.col("url")))
    return dedup_window(keyed, keys=["tab_id", "url_base"], window_ms=window_ms).drop("url_base")
