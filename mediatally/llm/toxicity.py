"""Toxicity of titles by a classifier that swapping identity terms must not move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from mediatally.llm.words import LOWER, NO_LETTER, Words, slices, span_hashes, words_of
from mediatally.session import stage

FEATURES = 1 << 20
PREFIXES = (4, 5, 6)
SAMPLE = 12_000  # labelled rows the classifier is fitted on, at most
LEAST_TITLES = 4
LEAST_CHI2 = 15.0
FAIRNESS = 4.0
RIDGE = 5e-5
STEPS = 800

# Groups of words of which one names a group of people as well as another; each is swapped for the next of its line.
IDENTITY_TERMS = (
    "women men girls boys",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino african european",
    "gay straight lesbian transgender bisexual",
    "immigrants refugees foreigners natives",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus",
    "schwarze weiße asiaten afrikaner",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous",
    "noirs blancs asiatiques africains",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos hindúes",
    "negros blancos asiáticos africanos",
)


def _lower(words: Words) -> Words:
    return Words(LOWER[words.data], words.start, words.length, words.first)


def word_features(words: Words) -> np.ndarray:
    """Feature numbers of every word: the word and its first bytes, one row per word; -1 where the word is too short."""
    out = np.full((len(words.start), 1 + len(PREFIXES)), -1, dtype=np.int64)
    out[:, 0] = (span_hashes(words.data, words.start, words.length, 1) % np.uint64(FEATURES)).astype(np.int64)
    for k, n in enumerate(PREFIXES, 1):
        long = words.length > n
        part = span_hashes(words.data, words.start[long], np.full(int(long.sum()), n), 1 + k)
        out[long, k] = (part % np.uint64(FEATURES)).astype(np.int64)
    return out


def _swaps() -> dict[int, tuple[list[int], list[int]]]:
    """By the feature number of an identity term: its features and those of the term it is swapped for."""
    found = {}
    for line in IDENTITY_TERMS:
        terms = line.split()
        feats = [[f for f in word_features(_lower(words_of(pa.array([t]), NO_LETTER)))[0].tolist() if f >= 0] for t in terms]
        for i, own in enumerate(feats):
            found[own[0]] = (own, feats[(i + 1) % len(feats)])
    return found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "title"):
        words = _lower(words_of(batch.column(0), NO_LETTER))
        feats, row = word_features(words), words.row
        lists = []
        for r in range(batch.num_rows):
            own = np.unique(feats[words.first[r]: words.first[r + 1]])
            lists.append(own[own >= 0].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1)], names=["features", "toxic"])


def telling(titles, toxic_titles, n, pos):
    """Whether a feature goes with the label: by a chi-squared test, for numpy arrays and columns alike. A feature is in
    `titles` of `n` titles and in `toxic_titles` of the `pos` toxic ones."""
    a, b = toxic_titles, titles - toxic_titles
    across = a * (n - pos - b) - b * (pos - a)
    return (titles >= LEAST_TITLES) & (n * across * across >= LEAST_CHI2 * titles * (n - titles) * pos * (n - pos))


def fit(features: list[np.ndarray], toxic: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic regression on the `chosen` ones of the given rows' feature sets.

    The loss has a ridge term and the mean squared change of the score when an identity term in a row is swapped for
    another one.
    """
    weights = np.zeros(FEATURES, np.float32)
    n, pos = len(toxic), float(toxic.sum())
    if n == 0 or pos in (0, n):
        return weights, 0.0 if n == 0 else (6.0 if pos else -6.0)
    row = np.repeat(np.arange(n), [len(f) for f in features])
    flat = np.concatenate(features).astype(np.int64)
    number = np.full(FEATURES, -1)
    number[chosen] = np.arange(len(chosen))
    # swaps: row by row the change of the feature counts
    pair, what, by, pairs = [], [], [], 0
    swaps = _swaps()
    marks = np.zeros(FEATURES, bool)
    marks[list(swaps)] = True
    for f in flat[marks[flat]].tolist():
        own, other = swaps[f]
        for g, sign in [(g, -1.0) for g in own] + [(g, 1.0) for g in other]:
            if number[g] >= 0:
                pair.append(pairs)
                what.append(number[g])
                by.append(sign)
        pairs += 1
    pair, what, by = np.array(pair, dtype=np.int64), np.array(what, dtype=np.int64), np.array(by)
    used = number[flat] >= 0
    row, col = row[used], number[flat[used]]
    k = len(chosen)
    w, bias = np.zeros(k), float(np.log(pos / (n - pos)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + bias
        err = 1 / (1 + np.exp(-z)) - toxic
        grad = np.append(np.bincount(col, weights=err[row], minlength=k) / n + RIDGE * w, err.mean())
        if pairs:
            moved = np.bincount(pair, weights=by * w[what], minlength=pairs)
            grad[:k] += FAIRNESS * np.bincount(what, weights=by * moved[pair], minlength=k) / pairs
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:k], bias - move[k]
    weights[chosen] = w
    return weights, float(bias)


def learn_toxicity(labelled: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and intercept from rows with `item_id`, `title` and `toxic` (0 or 1; NULL rows are left out).

    Fits on the rows given, at most `sample` of them. Features are counted by Spark; the chosen ones, and which of
    them and of the identity terms each row has, are what reaches the driver.
    """
    rows = stage(labelled.select("title", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        _features, "features array<int>, toxic int"), "title-features")
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = rows.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(
        F.count(F.lit(1)).cast("double").alias("titles"), F.sum("toxic").cast("double").alias("toxic_titles"))
    picked = counts.filter(telling(F.col("titles"), F.col("toxic_titles"), float(n), float(pos))).select("feature").toPandas()
    chosen = np.sort(picked["feature"].to_numpy(dtype=np.int64))
    wanted = np.zeros(FEATURES, bool)
    wanted[chosen] = True
    wanted[[f for pair in _swaps().values() for side in pair for f in side]] = True
    given = labelled.sparkSession.sparkContext.broadcast(wanted)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[f for f in own if given.value[f]] for own in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1)], names=["features", "toxic"])

    table = rows.mapInArrow(reduced, "features array<int>, toxic int").limit(sample).toPandas()  # more only where items repeat
    return fit([np.asarray(f, dtype=np.int64) for f in table["features"]], table["toxic"].to_numpy(dtype=float), chosen)


def sampled_labels(labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` rows of `item_id` and `toxic`, one per item, chosen by hash: the same at every run."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("item_id"), "item_id").limit(sample)


def title_toxicity(items: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Every item with `score` (0 to 1) and `predicted` (1 if score >= 0.5), learned from `labels` (`item_id`, `toxic`).

    `items` needs `item_id` and `title`; all its columns stay, `score` and `predicted` are added or replaced. Words
    are runs of letters in lower case; a word and its first 4, 5 and 6 bytes are features, and a feature counts once per
    title. NULL and empty titles get the score of a title without features. Several labels of one item count as the
    largest; NULL labels are left out; without any label every score is 0.5. Repeated rows each get the result; an
    empty table gives an empty one. The label sample has a fixed bound, so it is sent to all executors; the fitted
    weights are a table of fixed size. No step moves titles.
    """
    chosen = sampled_labels(labels, sample=sample).select(F.col("item_id").alias("_labelled"), "toxic")
    known = items.select("item_id", "title").join(F.broadcast(chosen), F.col("item_id") == F.col("_labelled"))
    weights, bias = learn_toxicity(known, sample=sample)
    return score_titles(items, weights, bias)


def score_titles(items: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    kept = items.drop("score", "predicted")
    columns = kept.columns
    at = columns.index("title")
    given = items.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = given.value
        for batch in slices(batches, "title"):
            words = _lower(words_of(batch.column(at), NO_LETTER))
            total = np.full(batch.num_rows, bias)
            if len(words.start):
                feats = word_features(words)
                hit = (feats >= 0) & (weights[feats] != 0)
                where = np.nonzero(hit)
                keys = np.unique(words.row[where[0]] * FEATURES + feats[where])
                total += np.bincount(keys // FEATURES, weights=weights[keys % FEATURES], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            values = [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(values, names=[*columns, "score", "predicted"])

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added]))
