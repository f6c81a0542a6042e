"""Running values over ordered groups that stay spread out when one group is huge.

A plain window sorts a whole group in one task. Here a group is cut into buckets along its order: each
(group, bucket) is scanned on its own, one small row per bucket carries its totals, and a second scan
over those rows gives every bucket what came before it. Buckets are a fixed function of the order
column and of written cuts, so a lost executor recomputes the same ones. The wide rows are shuffled once.

Where groups are many and small, cutting costs more than it saves: with `Busy`, groups of up to `PLAIN_ROWS` rows take a
plain window, and steps by the same or finer keys that follow each other share one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from mediatally.session import stage

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Running:
    """One running value: `how` is sum, max, count, last (latest non-null before or at the row) or next
    (earliest non-null after the row). `exclusive` leaves the row itself out; next is always exclusive."""

    how: str
    value: Column
    exclusive: bool = False


# a bucket with more rows than this is cut again, into so many parts
MOST_ROWS = 1 << 20
PARTS = 64
# a group with more rows than this is cut into buckets
PLAIN_ROWS = 1 << 16


def _key_of(keys: list[str]) -> Column:
    # one struct, because structs are equal where both have NULL: windows, sums and joins agree on it
    return F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keys])


@dataclass(frozen=True)
class Busy:
    """The groups of `keys` with more than `PLAIN_ROWS` rows, as a small written table of `_busy`, or None if there is none.
    It holds for every table whose groups of the same or finer keys have no more rows than those that were counted."""

    keys: list[str]
    found: DataFrame | None

    @staticmethod
    def of(df: DataFrame, keys: list[str]) -> Busy:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PLAIN_ROWS)
        found = stage(sizes.select(_key_of(keys).alias("_busy")), "busy-groups")
        return Busy(keys, found if found.limit(1).count() else None)

    def split(self, df: DataFrame, plain: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`plain` of the rows of small groups and `spread` of those of busy ones, together."""
        if self.found is None:
            return plain(df)
        met = _key_of(self.keys) == F.col("_busy")
        return plain(df.join(self.found, met, "left_anti")).unionByName(spread(df.join(self.found, met, "left_semi")))


@dataclass(frozen=True)
class Spans:
    """Buckets of `width` along an integer order column, cut finer where a group is busy.

    Rows are counted per group and bucket. Where one holds more than `MOST_ROWS`, a quantile sketch over its rows gives the
    places of the inner cuts, so that one group with a third of all rows within a minute is spread over many tasks.
    Only these few buckets' cuts meet the rows, as a small written table. Results do not depend on the cuts.
    """

    column: str
    width: int

    def cut(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
        """`df`, with a column `_inner` if any bucket is cut again, and the bucket to use."""
        bucket = every(self.column, self.width)
        key = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keys])
        rows = df.select(key.alias("_busy_key"), bucket.alias("_busy_bucket"), F.col(self.column).alias("_at"))
        cell = ["_busy_key", "_busy_bucket"]
        busy = stage(rows.groupBy(*cell).count().filter(F.col("count") > MOST_ROWS).select(*cell), "busy-buckets")
        if not busy.limit(1).count():
            return df, bucket
        shares = F.percentile_approx("_at", [i / PARTS for i in range(1, PARTS)], F.lit(10_000))
        cuts = stage(rows.join(busy, cell).groupBy(*cell).agg(F.array_distinct(shares).alias("_cuts")), "bucket-cuts")
        joined = df.join(cuts, (key == F.col("_busy_key")) & (bucket == F.col("_busy_bucket")), "left")
        inner = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(self.column))), F.lit(0))
        inner = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(inner)
        return joined.withColumn("_inner", inner).drop(*cell, "_cuts"), F.struct(bucket.alias("b"), F.col("_inner").alias("i"))


def every(column: str, width: int) -> Column:
    """Bucket number for an integer order column; it never decreases along the order."""
    return F.coalesce(F.expr(f"`{column}` div {width}"), F.lit(-(2**63)))  # NULL comes first in a window's order, too


def running(df: DataFrame, *, keys: list[str], order: list[str], bucket: Column | Spans, busy: Busy | None = None,
            **wanted: Running) -> DataFrame:
    """`df` with the wanted running columns. `order` must be unique within a group and `bucket` must not decrease
    along it. NULL is a key like any other, as in a plain window. With `busy` only the groups named there are cut."""
    columns = [*[c for c in df.columns if c not in wanted], *wanted]

    def plain(rows: DataFrame) -> DataFrame:
        local, _ = _within(Window.partitionBy(*keys).orderBy(*order), order, wanted)
        return rows.withColumns(local).select(*columns)

    def spread(rows: DataFrame) -> DataFrame:
        return _carried(rows, keys, order, bucket, wanted).select(*columns)

    return busy.split(df, plain, spread) if busy else spread(df)


def _within(group: WindowSpec, order: list[str], wanted: dict[str, Running]) -> tuple[dict[str, Column], list[Column]]:
    """The running values within a window, and the totals of one as aggregates."""
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    after = group.rowsBetween(1, Window.unboundedFollowing)
    position = F.struct(*[F.col(c) for c in order])

    local, totals = {}, []
    for name, r in wanted.items():
        frame = before if r.exclusive else upto
        if r.how in ("sum", "count"):
            fn = F.sum if r.how == "sum" else F.count
            local[name] = F.coalesce(fn(r.value).over(frame), F.lit(0))
            totals.append(fn(r.value).alias(f"_t_{name}"))
        elif r.how == "max":
            local[name] = F.max(r.value).over(frame)
            totals.append(F.max(r.value).alias(f"_t_{name}"))
        elif r.how == "last":
            local[name] = F.last(r.value, ignorenulls=True).over(frame)
            totals.append(F.max_by(r.value, F.when(r.value.isNotNull(), position)).alias(f"_t_{name}"))
        elif r.how == "next":
            local[name] = F.first(r.value, ignorenulls=True).over(after)
            totals.append(F.min_by(r.value, F.when(r.value.isNotNull(), position)).alias(f"_t_{name}"))
        else:
            raise ValueError(f"unknown running value {r.how}")
    return local, totals


def _carried(df: DataFrame, keys: list[str], order: list[str], bucket: Column | Spans, wanted: dict[str, Running]) -> DataFrame:
    """Running values within buckets, joined with what came before the bucket."""
    b, k = "_bucket", "_key"
    if isinstance(bucket, Spans):
        df, bucket = bucket.cut(df, keys)
    df = df.withColumns({b: bucket, k: _key_of(keys)})
    local, totals = _within(Window.partitionBy(k, b).orderBy(*order), order, wanted)
    carried = Window.partitionBy(k).orderBy(b)
    earlier = carried.rowsBetween(Window.unboundedPreceding, -1)
    later = carried.rowsBetween(1, Window.unboundedFollowing)
    carry = {
        name: {
            "sum": lambda t: F.sum(t).over(earlier),
            "count": lambda t: F.sum(t).over(earlier),
            "max": lambda t: F.max(t).over(earlier),
            "last": lambda t: F.last(t, ignorenulls=True).over(earlier),
            "next": lambda t: F.first(t, ignorenulls=True).over(later),
        }[r.how](F.col(f"_t_{name}"))
        for name, r in wanted.items()
    }
    carries = df.groupBy(k, b).agg(*totals).select(k, b, *[c.alias(f"_c_{n}") for n, c in carry.items()])
    scanned = df.withColumns(local).join(carries, [k, b], "left")
    combined = {}
    for name, r in wanted.items():
        own, prior = F.col(name), F.col(f"_c_{name}")
        if r.how in ("sum", "count"):
            combined[name] = own + F.coalesce(prior, F.lit(0))
        elif r.how == "max":
            combined[name] = F.greatest(own, prior)
        else:
            combined[name] = F.coalesce(own, prior)
    return scanned.withColumns(combined)


def numbered(df: DataFrame, *, keys: list[str], order: list[str], bucket: Column | Spans, name: str = "rank",
             busy: Busy | None = None) -> DataFrame:
    """1-based row number within each group."""
    return running(df, keys=keys, order=order, bucket=bucket, busy=busy, **{name: Running("count", F.lit(1))})


def numbered_runs(df: DataFrame, *, keys: list[str], order: list[str], bucket: Column, value: Column, link: Column, name: str,
                  busy: Busy | None = None) -> DataFrame:
    """`df` with the 1-based number of the run each row lies in. A row starts a run if its `value` is not the `link` of
    the row before it (NULLs are equal), so `value` and `link` are the same column for runs of equal values.

    One pass: per bucket its first value, last link and inner starts are enough to number the runs of the next ones.
    With `busy` only the groups named there are cut into buckets.
    """
    columns = [*[c for c in df.columns if c != name], name]

    def plain(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys).orderBy(*order)
        before = F.lag(F.struct(link.alias("x"))).over(group)
        starts = (before.isNull() | (before["x"].eqNullSafe(value) == F.lit(False))).cast("bigint")
        upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(upto)).select(*columns)

    def spread(rows: DataFrame) -> DataFrame:
        return _runs_carried(rows, keys, order, bucket, value, link, name).select(*columns)

    return busy.split(df, plain, spread) if busy else spread(df)


def _runs_carried(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, link: Column, name: str) -> DataFrame:
    """Runs numbered within buckets, joined with the number of the first one there."""
    b, k = "_bucket", "_key"
    rows = df.withColumns({b: bucket, k: _key_of(keys), "_v": F.struct(value.alias("x")), "_l": F.struct(link.alias("x"))})
    group = Window.partitionBy(k, b).orderBy(*order)
    before = F.lag("_l").over(group)
    rows = rows.withColumn("_inner", (before.isNotNull() & (before["x"].eqNullSafe(F.col("_v.x")) == F.lit(False))).cast("bigint"))
    scanned = rows.withColumn("_upto", F.sum("_inner").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    position = F.struct(*[F.col(c) for c in order])
    cut = scanned.groupBy(k, b).agg(
        F.min_by("_v", position).alias("head"), F.max_by("_l", position).alias("tail"), F.sum("_inner").alias("inner"))
    carried = Window.partitionBy(k).orderBy(b)
    last = F.lag("tail").over(carried)
    cut = cut.withColumn("starts", (last.isNull() | (last["x"].eqNullSafe(F.col("head.x")) == F.lit(False))).cast("bigint"))
    prior = F.coalesce(F.sum(F.col("starts") + F.col("inner")).over(carried.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.select(k, b, (prior + F.col("starts")).alias("_start"))
    return scanned.join(cut, [k, b]).withColumn(name, F.col("_start") + F.col("_upto"))
