"""Repeated runs of lines in manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from mediatally.session import stage

WINDOW = 3


def line_windows(manifests: DataFrame) -> DataFrame:
    """`manifest_id`, `body_key`, `start`, `h1`, `h2`: one row per three consecutive lines, named by 128 bits."""
    lines = F.split(F.coalesce("body", F.lit("")), "\n", -1)
    rows = manifests.select("manifest_id", F.xxhash64("body").alias("body_key"), lines.alias("lines"))
    rows = rows.filter(F.size("lines") >= WINDOW)
    starts = F.sequence(F.lit(0), F.size("lines") - F.lit(WINDOW))
    windows = F.transform(starts, lambda i: F.concat_ws("\n", F.slice("lines", i + 1, F.lit(WINDOW))))
    rows = rows.select("manifest_id", "body_key", F.posexplode(windows).alias("start", "window"))
    return rows.select("manifest_id", "body_key", "start", F.xxhash64("window").alias("h1"),
                       F.xxhash64(F.lit(WINDOW), F.reverse("window")).alias("h2"))


def _without_covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, body, starts, copy in zip(batch["manifest_id"], batch["body"], batch["starts"], batch["copy"]):
            lines = (body or "").split("\n")
            keep = np.ones(len(lines), dtype=bool)
            if copy > 1 and len(lines) >= WINDOW:  # every window stood in the first copy
                keep[:] = False
            elif starts is not None:
                at = np.asarray(starts, dtype=np.int64)
                for k in range(WINDOW):
                    keep[at + k] = False
            text = "\n".join(line for line, k in zip(lines, keep) if k)
            out.append((key, len(lines), int(len(lines) - keep.sum()), text,
                        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
        yield pd.DataFrame(out, columns=["manifest_id", "n_lines", "n_removed", "kept_body", "kept_sha256"]).astype(
            {"manifest_id": batch["manifest_id"].dtype})


def drop_repeated_lines(manifests: DataFrame) -> DataFrame:
    """Manifests without runs of three lines that stood somewhere before.

    `manifests` needs `manifest_id` and `body`; other columns are not read. Every three consecutive lines are a
    window; windows overlap. Of equal windows in all manifests the first stays: smallest id, then smallest line
    number. Every line that another occurrence covers goes. Returns one row per input row: `manifest_id`, `n_lines`,
    `n_removed`, `kept_body` (remaining lines joined by line feeds) and `kept_sha256`.

    Lines end at a line feed and are compared as they are. A NULL body is one empty line. Bodies of one or two lines
    have no window and stay. NULL ids come first. Of rows that repeat id and body
    the second and later ones are later occurrences with all their windows. An empty table gives an empty one.

    A window is a 128-bit hash; a frequent window is summed up before the shuffle, and occurrences meet it by a join
    between written tables, where Spark splits a hot key. Bodies move to number equal rows and to meet their
    covered positions.
    """
    windows = line_windows(manifests).select("h1", "h2", F.struct("manifest_id", "body_key", "start").alias("at"))
    windows = stage(windows, "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stage(first.filter("n > 1").drop("n"), "repeated-windows")
    later = windows.join(first, ["h1", "h2"]).filter(F.col("at") != F.col("first"))
    covered = later.groupBy(F.col("at.manifest_id").alias("_id"), F.col("at.body_key").alias("_key")).agg(
        F.collect_set("at.start").alias("starts"))
    rows = manifests.select("manifest_id", "body", F.xxhash64("body").alias("body_key"))
    equal = Window.partitionBy("manifest_id", "body_key").orderBy("body_key")
    rows = rows.withColumn("copy", F.row_number().over(equal))
    met = rows.join(covered, F.col("manifest_id").eqNullSafe(F.col("_id")) & (F.col("body_key") == F.col("_key")), "left")
    kind = manifests.schema["manifest_id"].dataType.simpleString()
    return met.select("manifest_id", "body", "starts", "copy").mapInPandas(
        _without_covered, f"manifest_id {kind}, n_lines bigint, n_removed bigint, kept_body string, kept_sha256 string")
