"""Exact copies of manifests by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediatally.session import stage

BLANKS = " \t\n\x0b\x0c\r"
# a chunk ends at the first punctuation mark after 256 characters, or after 2048
CHUNK = r"(?s).{256,2048}?[.,;:!?]|.{1,2048}"


def without_blanks(body: Column) -> Column:
    """The body with all blanks and line ends deleted; NULL is empty."""
    return F.translate(F.coalesce(body, F.lit("")), BLANKS, "")


def chunks_of(bare: Column) -> Column:
    """The body cut where its own content says so; an empty body is one empty chunk."""
    cut = F.regexp_extract_all(bare, F.lit(CHUNK), F.lit(0))
    return F.when(F.length(bare) > 0, cut).otherwise(F.array(F.lit("")))


def contested_hashes(chunks: DataFrame) -> DataFrame:
    """Hashes that two different chunks share: `hash` and the sorted `texts`.

    Rows need `hash` and `chunk`. Equal chunks are merged before the shuffle, so each distinct chunk of a task
    moves once, however many documents hold it. Texts per hash are one, or few where 64 bits collide.
    """
    texts = chunks.groupBy("hash").agg(F.collect_set("chunk").alias("texts"))
    return texts.filter(F.size("texts") > 1).select("hash", F.sort_array("texts").alias("texts"))


def exact_copies(manifests: DataFrame) -> DataFrame:
    """Groups of manifests whose bodies are equal after deleting blanks and line ends.

    `manifests` needs `manifest_id` and `body`; other columns are not read. Returns one row per input row:
    `manifest_id`, `keep_id`, `group_size`, `kept`, `n_points` (code points of the body as given) and `body_sha256`
    (of the bare body, lowercase hex). Of equal bodies the row with the most code points stays, then the smallest id,
    NULL ids last. A NULL body counts as empty. Rows that repeat id, length and bare body all get their group's
    result and only one of them is kept. An empty table gives an empty one.

    Bodies are cut into chunks at places their content determines. A chunk's identifier is its 64-bit hash, made
    unique by comparing the chunks themselves: where different texts share a hash, the text's place among them is
    added. Bodies are equal when their ordered identifier lists are. Whole bodies never move; a chunk moves once per
    task that reads it. A large group is summed up before it meets in one row, and rows find their group by a join
    between two written tables, where Spark splits a hot key.
    """
    bare = without_blanks(F.col("body"))
    rows = manifests.select(
        "manifest_id", F.length(F.coalesce("body", F.lit(""))).alias("n_points"), bare.alias("bare"))
    cut = rows.select(
        "manifest_id", "n_points", F.sha2("bare", 256).alias("body_sha256"), F.posexplode(chunks_of(F.col("bare"))).alias("pos", "chunk"))
    cut = cut.withColumn("hash", F.xxhash64("chunk"))
    contested = stage(contested_hashes(cut.select("hash", "chunk")), "contested-chunks")
    named = cut.join(contested, "hash", "left").withColumn(
        "place", F.coalesce(F.array_position("texts", F.col("chunk")), F.lit(0)))
    own = ["manifest_id", "n_points", "body_sha256"]
    # rows that repeat all three are one recipe with a count
    recipes = named.groupBy(*own).agg(
        F.array_distinct(F.sort_array(F.collect_list(F.struct("pos", "hash", "place")))).alias("_ordered"),
        F.count_if(F.col("pos") == 0).alias("rows"))
    recipe = F.transform("_ordered", lambda c: F.struct(c["hash"], c["place"]))
    recipes = stage(recipes.select(*own, "rows", recipe.alias("recipe")), "chunk-recipes")
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("manifest_id").isNull().alias("u"), F.col("manifest_id").alias("id")))
    groups = recipes.groupBy("recipe").agg(F.sum("rows").alias("group_size"), best.alias("best"))
    groups = stage(groups.filter("group_size > 1"), "recipe-groups")
    joined = recipes.join(groups, "recipe", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    alone = F.col("group_size").isNull()
    chosen = (F.col("best.id").eqNullSafe(F.col("manifest_id"))) & (-F.col("best.n") == F.col("n_points"))
    return joined.select(
        "manifest_id", F.when(alone, F.col("manifest_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        ((alone | chosen) & (F.col("copy") == 1)).alias("kept"), "n_points", "body_sha256")
