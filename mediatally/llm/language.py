"""Language of titles by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mediatally.llm.words import LOWER, NO_LETTER, U64, mix, slices, text_bytes
from mediatally.session import stage

GRAM = 4  # bytes
SLOTS = 1 << 20
PROBES = 3
PLANE = 62  # languages per 64-bit mask
LEAST_COUNT = 3
LEAST_RATE = 1e-5  # an n-gram that makes up less of a language's text is left out: at most 1 / LEAST_RATE per language
SHARE = 0.2  # … and one that is rarer than this share of its rate in another language
NO_LANGUAGE = "und"
FOLDED = np.where(NO_LETTER, np.uint8(0x20), LOWER)


def grams_of(titles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, row of each): runs of four bytes of the folded title with at most one blank among them."""
    data, at = text_bytes(titles)
    size = np.diff(at) + 2  # a blank before and after
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    if len(data):
        rows = np.repeat(np.arange(len(size)), np.diff(at))
        out[np.arange(len(data)) + 2 * rows + 1] = FOLDED[data]
    n = len(out) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint32)
    blanks = np.zeros(n, np.int8)
    is_blank = out == 0x20
    for k in range(GRAM):
        grams = (grams << np.uint32(8)) | out[k: k + n]
        blanks += is_blank[k: k + n]
    good = (blanks <= 1) & (row[:n] == row[GRAM - 1:])
    return grams[good], row[:n][good]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        g, c = held.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array(g.astype(np.int64)), pa.array([lang] * len(g), pa.string()), pa.array(c.astype(np.int64))], names=["gram", "lang", "n"])

    for batch in slices(batches, "title"):
        grams, row = grams_of(batch.column(0))
        langs = pd.factorize(batch.column(1).to_pandas())
        of = langs[0][row]
        for i, lang in enumerate(langs[1]):
            g, c = np.unique(grams[of == i], return_counts=True)
            if lang in held:
                both = np.concatenate([held[lang][0], g])
                g, at = np.unique(both, return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([held[lang][1], c]), minlength=len(g)).astype(np.int64)
            held[lang] = (g, c)
            if len(g) > 1 << 20:  # bounds the memory; parts are summed up again later
                yield out(lang)
    for lang in list(held):
        yield out(lang)


@dataclass
class Filters:
    """`planes[p][slot]` holds bit l if an n-gram of language p * PLANE + l falls on the slot; `missed[l]` is how often an
    n-gram of no language seems to be in language l. Languages are in descending order of their text."""

    langs: list[str]
    planes: list[np.ndarray]
    missed: np.ndarray


def _slots(grams: np.ndarray, probe: int) -> np.ndarray:
    return (mix(grams.astype(U64) * U64(8) + U64(probe)) % U64(SLOTS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column(0).to_numpy(zero_copy_only=False)
        cols = [np.concatenate([_slots(grams, k) for k in range(PROBES)])] + [
            np.tile(batch.column(i).to_numpy(zero_copy_only=False), PROBES) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["slot", "plane", "mask"])


def learn_languages(items: DataFrame) -> Filters:
    """Filters from all rows of `items` (`title`, `lang`) whose lang is not NULL.

    N-grams are counted over all these titles, merged per task and then by Spark. A language's filter gets those that
    make up enough of its text; their number has a bound that does not depend on the corpus, and so has the table of
    slots, the only thing besides one row per language that reaches the driver.
    """
    known = items.filter(F.col("lang").isNotNull()).select("title", "lang")
    counts = known.mapInArrow(_count, "gram bigint, lang string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = stage(counts, "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    listed = totals.orderBy(F.desc("total"), "lang").toPandas()
    langs = listed["lang"].tolist()
    planes = [np.zeros(SLOTS, U64) for _ in range(max(1, -(-len(langs) // PLANE)))]
    if not langs:
        return Filters([], planes, np.zeros(0))
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    rates = counts.join(totals, "lang").withColumns({"rate": F.col("n") / F.col("total"), "l": number})
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("l", "rate", "n")).alias("of"))
    mine = F.filter("of", lambda x: (x["n"] >= LEAST_COUNT) & (x["rate"] >= LEAST_RATE) & (x["rate"] >= F.col("top") * SHARE))
    one = top.select("gram", F.explode(mine).alias("x")).select(
        "gram", (F.col("x.l") / PLANE).cast("bigint").alias("plane"), F.expr(f"shiftleft(1L, int(x.l % {PLANE}))").alias("mask"))
    masks = one.groupBy("gram", "plane").agg(F.bit_or("mask").alias("mask"))
    slots = masks.mapInArrow(_bits, "slot bigint, plane bigint, mask bigint").groupBy("slot", "plane").agg(F.bit_or("mask").alias("mask"))
    table = slots.toPandas()
    for plane, part in table.groupby("plane"):
        planes[int(plane)][part["slot"].to_numpy()] = part["mask"].to_numpy().view(U64)
    filled = [np.count_nonzero(planes[i // PLANE] & (U64(1) << U64(i % PLANE))) / SLOTS for i in range(len(langs))]
    return Filters(langs, planes, np.array(filled) ** PROBES)


def languages_of(titles: pa.Array, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language or -1, score) per title."""
    n = len(titles)
    data, at = text_bytes(titles)
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~NO_LETTER[data] & (data < 0x80), out=plain[1:])
    lettered = plain[at[1:]] > plain[at[:-1]]
    for i in np.flatnonzero(~lettered):
        lettered[i] = any(c.isalpha() for c in titles[i].as_py() or "")
    best, score = np.full(n, -1), np.zeros(n)
    if not filters.langs:
        return best, score
    grams, row = grams_of(titles)
    seen = np.bincount(row, minlength=n)
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    slots = [_slots(grams, k) for k in range(PROBES)]
    share = np.zeros((len(filters.langs), n))
    for p, plane in enumerate(filters.planes):
        mask = plane[slots[0]]
        for s in slots[1:]:
            mask &= plane[s]
        for i in range(p * PLANE, min(len(filters.langs), (p + 1) * PLANE)):
            if len(row):
                hits = np.add.reduceat(((mask >> U64(i % PLANE)) & U64(1)).astype(np.int64), heads)
                rest = 1 - filters.missed[i]
                share[i, row[heads]] = (hits / seen[row[heads]] - filters.missed[i]) / rest if rest > 0 else 0
    share = np.clip(share, 0, 1)
    best = np.where(lettered, share.argmax(axis=0), -1)
    return best, np.where(lettered, share.max(axis=0), 0.0)


def predict_languages(items: DataFrame, filters: Filters) -> DataFrame:
    """`items` with `lang_pred` and `score` added (columns of these names are replaced); only `title` is read for them."""
    kept = items.drop("lang_pred", "score")
    given = items.sparkSession.sparkContext.broadcast(filters)  # SLOTS masks per plane
    columns = kept.columns
    at = columns.index("title")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = given.value
        names = np.array([*filters.langs, NO_LANGUAGE], dtype=object)
        for batch in slices(batches, "title"):
            best, score = languages_of(batch.column(at), filters)
            values = [*batch.columns, pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(values, names=[*columns, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(run, schema)


def title_languages(items: DataFrame, training: Column) -> DataFrame:
    """Every item with `lang_pred` and `score`; learns from the rows where `training` holds and lang is not NULL.

    `items` needs `title` and `lang`; all its columns stay. A title's n-grams (four bytes, ASCII letters in lower
    case, other ASCII characters as blanks) are looked up in one table whose slots hold one bit per language; the
    bits common to all probes are the languages that have the n-gram. The share of a title's n-grams that a language
    has, less the share that would seem to be there by chance, is its score; the largest decides, then the language
    with more text. A title that is NULL or has no letter is `und` with score 0, and so is every title when there is
    nothing to learn from; a lettered title without a known n-gram gets the language with most text and score 0.
    Repeated rows each get the result; an empty table gives an empty one.
    """
    return predict_languages(items, learn_languages(items.filter(training)))
