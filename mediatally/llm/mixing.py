"""Mixing the titles of several sites to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediatally.llm.words import free_name
from mediatally.session import stage

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"
ADDED = ("size", "site_size", "target", "rate", "copies", "taken")


def title_size(title: Column) -> Column:
    """Words of a title: runs of characters other than blank and tab to carriage return; NULL has none."""
    return F.coalesce(F.regexp_count(title, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def site_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """`site`, `site_size` and `target`, one row per site, from rows with `site` and `size`.

    Sites in code point order, NULL last, get the weights in turn and share the sum of all sizes. A target stops at
    `max_rate` times its site's size and the rest is shared again by weight. That has a closed form: in ascending
    order of size per weight the first sites are at their limit, and from the first one that is not, all take the
    same amount per weight. Only one row per site reaches the ordered windows; sizes are summed before the shuffle.
    """
    sites = sizes.groupBy("site").agg(F.sum("size").alias("site_size"))
    by_name = Window.orderBy(F.col("site").isNull(), "site")
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    sites = sites.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("bigint"))
    filling = Window.orderBy(F.col("site_size") / F.col("_w"), F.col("site").isNull(), "site")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("site_size") * max_rate
    left = F.sum("site_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    sites = sites.withColumns({"_n": F.row_number().over(filling), "_share": left.cast("double") / F.sum("_w").over(after)})
    free = F.col("_share") * F.col("_w") <= limit
    sites = sites.withColumns({
        "_first": F.min(F.when(free, F.col("_n"))).over(everything),
        "_level": F.min_by("_share", F.when(free, F.col("_n"))).over(everything)})
    target = F.when(F.col("_n") < F.col("_first"), limit.cast("double")).otherwise(F.col("_level") * F.col("_w"))
    return sites.select("site", "site_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sites(items: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """Every item of `items` with how often the mix takes it: `copies` times, `taken` words in all.

    `items` needs `item_id`, `site` and `title`. All its columns stay; `size` (words of the title), `site_size`,
    `target` (the words its site should give), `rate` (target / site_size), `copies` and `taken` are added and
    replace columns of these names. An item is taken floor(rate) times, and once more if a number in [0, 1) drawn
    from the seed, its id and its title lies below the rate's fraction: reruns agree, whatever the partitioning.
    NULL titles have size 0, a NULL site is a site, a site without words has target 0. Rows with the same id and
    title draw the same number. An empty table gives an empty one. The target table has one row per site; Spark
    sends it to all executors only while its size permits, and joins by site with split hot sites otherwise.
    """
    kept = items.select(*[c for c in items.columns if c not in ADDED])
    # drawn before the join, so that a caller who wants no titles moves none
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("title", F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    drawn, of = free_name([*items.columns, *ADDED], "_draw"), free_name([*items.columns, *ADDED], "_site")
    sized = kept.withColumns({"size": title_size(F.col("title")), drawn: draw})
    # written, so that its size is known when the join is planned: titles stay where they are as long as it is small
    targets = stage(site_targets(sized.select("site", "size"), weights=weights, max_rate=max_rate), "site-targets")
    targets = targets.withColumnRenamed("site", of)
    out = sized.join(targets, F.col("site").eqNullSafe(F.col(of)), "left").drop(of)
    rate = F.when(F.col("site_size") > 0, F.least(F.col("target") / F.col("site_size"), F.lit(float(max_rate)))).otherwise(0.0)
    whole = F.floor("rate")
    out = out.withColumn("rate", rate).withColumn(
        "copies", (whole + F.when(F.col(drawn) < F.col("rate") - whole, 1).otherwise(0)).cast("bigint"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*kept.columns, *ADDED)


def emit_mix(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of `mix_sites` as often as its `copies` say, without the added columns. Other columns stay,
    whatever their names; a row with a NULL number of copies is left out, an empty table gives an empty one."""
    copy = free_name(mixed.columns, "_copy")
    rows = mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.drop(copy, *ADDED)
