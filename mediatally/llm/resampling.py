"""Drawing titles that resemble a target: importance weights over hashed word features with a head-tail vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mediatally.llm.words import slices, text_bytes
from mediatally.session import stage

LONGEST = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
HEAD = 65_536  # frequent words, and as many frequent runs of each greater length, that every executor holds
LONGEST_HEAD = 64  # bytes of a run in the head; longer ones belong to the tail
COUNTED = 300_000  # distinct words a task counts before it passes them on

# words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z become a-z, other bytes part words
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(titles: pa.Array) -> list[list[bytes]]:
    """Lower-cased words per title; NULL has none."""
    data, at = text_bytes(titles)
    whole, ends = data.tobytes().translate(_BYTES), at.tolist()
    return [whole[a:b].split() for a, b in zip(ends, ends[1:])]


@dataclass
class Head:
    """CRC states of frequent words (a run that starts with the word goes on from its state) and buckets of frequent
    longer runs. Everything else is the tail: its CRC is taken from its bytes."""

    states: dict[bytes, int] = field(default_factory=dict)
    runs: dict[bytes, int] = field(default_factory=dict)


def _counts(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = [k for k in held if len(k) <= LONGEST_HEAD]
            return pa.RecordBatch.from_arrays(
                [pa.array([k.decode("utf-8", "replace") for k in keys], pa.string()), pa.array([k.count(b" ") + 1 for k in keys], pa.int64()),
                 pa.array([held[k] for k in keys], pa.int64())], names=["run", "length", "n"])

        for batch in slices(batches, "title"):
            for words in words_of(batch.column(0)):
                held.update(words)
                for n in range(2, longest + 1):
                    held.update(map(b" ".join, zip(*[words[k:] for k in range(n)])))
            if len(held) > COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def frequent_runs(titles: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, head: int = HEAD) -> Head:
    """The head of the vocabulary: for every length up to `longest` the `head` most frequent runs of at most 64 bytes.

    All titles are counted; ties go by code point. Only the head reaches the driver and the executors: `head` runs of
    64 bytes per length, whatever the corpus.
    """
    counted = titles.select("title").mapInArrow(_counts(longest), "run string, length bigint, n bigint")
    counted = counted.groupBy("run", "length").agg(F.sum("n").alias("n"))
    if longest > 1:
        counted = stage(counted, "run-counts")  # read once per length
    top = Head()
    for n in range(1, longest + 1):
        rows = counted.filter(F.col("length") == n).orderBy(F.desc("n"), "run").limit(head).select("run").toArrow()
        for run in rows.column(0).to_pylist():
            raw = run.encode()
            if n == 1:
                top.states[raw] = crc32(raw)
            else:
                top.runs[raw] = crc32(raw) % buckets
    return top


def features_of(titles: list[list[bytes]], head: Head, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, number of features per title), a title's features one after another."""
    flat = [w for words in titles for w in words]
    states = np.fromiter(map(head.states.get, flat, repeat(-1)), np.int64, len(flat))
    tail = np.flatnonzero(states < 0)
    states[tail] = np.fromiter((crc32(flat[i]) for i in tail.tolist()), np.int64, len(tail))
    sizes = np.array([len(words) for words in titles], np.int64)
    if longest == 1:
        return states % buckets, sizes
    parts, counts = [], np.zeros(len(titles), np.int64)
    first = 0
    for t, words in enumerate(titles):
        own = states[first: first + len(words)]
        first += len(words)
        parts.append(own % buckets)
        counts[t] += len(own)
        states_n, spelled = own.tolist(), words
        for n in range(2, longest + 1):
            follow = words[n - 1:]
            spelled = [a + b" " + b for a, b in zip(spelled, follow)]
            known = [head.runs.get(s, -1) for s in spelled]
            # a run goes on from the CRC state of the run without its last word
            states_n = [crc32(b" " + b, s) for s, b in zip(states_n, follow)] if n < longest or min(known, default=0) < 0 else states_n
            parts.append(np.array([k if k >= 0 else s % buckets for k, s in zip(known, states_n)], np.int64))
            counts[t] += len(spelled)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), counts


def bucket_totals(titles: DataFrame, head: Head, *, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all `titles` per bucket. Tasks hold one number per bucket; Spark adds them up."""
    given = titles.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in slices(batches, "title"):
            held += np.bincount(features_of(words_of(batch.column(0)), given.value, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["bucket", "n"])

    counted = titles.select("title").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    rows = counted.toArrow()  # one row per bucket
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the corpus, smoothed by one, rounded down."""
    buckets = len(corpus)
    up = (target + 1).astype(float) * float(corpus.sum() + buckets)
    down = (corpus + 1).astype(float) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def title_weights(items: DataFrame, gains: np.ndarray, head: Head, *, longest: int = LONGEST) -> DataFrame:
    """`item_id`, `n_words`, `n_features` and `weight` (mean gain of the features, rounded down; 0 without any)."""
    given = items.sparkSession.sparkContext.broadcast((gains, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, head = given.value
        for batch in slices(batches, "title"):
            words = words_of(batch.column(1))
            bucket, n = features_of(words, head, longest, len(gains))
            ends = np.concatenate([[0], np.cumsum(gains[bucket])])
            at = np.concatenate([[0], np.cumsum(n)])
            weight = (ends[at[1:]] - ends[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(n), pa.array(weight)],
                names=["item_id", "n_words", "n_features", "weight"])

    schema = StructType([items.schema["item_id"], *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return items.select("item_id", "title").mapInArrow(run, schema)


def draw_like(items: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
              percent: int = PERCENT, seed: str = SEED, head: int = HEAD) -> DataFrame:
    """Draw the `percent` of the items whose titles resemble the target texts, by importance with Gumbel noise.

    `items` needs `item_id` and `title`, `target` needs `title` (texts of the wanted kind); other columns are not read,
    whatever their names. Returns one row per item: `item_id`, `n_features`, `weight`, `score`, `rank` (1, 2, 3 … by
    descending score, then ascending id; NULL if not drawn). Features are all runs of one to `longest` words, repeats
    counted. Items with `min_words` words or more take part, and floor(percent * N / 100) of them are drawn. The noise
    comes from `seed` and the id alone, so reruns agree. NULL and empty titles have no features and weight 0. A NULL
    id draws as an empty one and comes last among equal scores. Repeated rows each take part; equal ones have
    consecutive ranks. Empty items give an empty result; an empty target leaves the weights to the corpus. Titles are
    read whole, whatever their length.

    Three passes over the titles: the counts of the head, exact totals per bucket, the weights. Nothing but the head
    (bounded by `head`) and one number per bucket is broadcast. Ranks come from a histogram of the scores, whose
    distinct values are bounded by logarithms of the counts: a score's first rank is known from the scores above it,
    and only the drawn scores' rows are ordered, one score at a time. Equal rows are merged before that.
    """
    spoken = items.select("item_id", "title")
    wanted = target.select("title")
    top = frequent_runs(spoken, longest=longest, buckets=buckets, head=head)
    totals = [bucket_totals(t, top, longest=longest, buckets=buckets) for t in (spoken, wanted)]
    weighed = title_weights(spoken, bucket_gains(*totals), top, longest=longest)

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")
    own = ["item_id", "n_features", "weight", "score", "able"]
    scored = weighed.withColumns({"score": F.col("weight") + noise, "able": F.col("n_words") >= min_words})
    rows = stage(scored.groupBy(*own).agg(F.count(F.lit(1)).alias("copies")), "scored-titles")

    # one row per score: small whatever the corpus
    scores = rows.filter("able").groupBy("score").agg(F.sum("copies").alias("n"))
    downward = Window.orderBy(F.desc("score"))
    before = F.coalesce(F.sum("n").over(downward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_rows = F.sum("n").over(downward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scores = scores.select("score", before.alias("before"), all_rows.alias("able_rows"))
    drawn = F.floor(F.col("able_rows") * percent / 100).cast("bigint")
    scores = stage(scores.select("score", "before", drawn.alias("drawn")).filter("before < drawn"), "drawn-scores")

    joined = rows.join(scores.withColumn("able", F.lit(True)), ["score", "able"], "left")
    within = Window.partitionBy("score").orderBy(F.col("item_id").isNull(), "item_id", "n_features", "weight")
    earlier = F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = joined.filter("before IS NOT NULL").withColumn("first", F.col("before") + earlier + 1)
    left = joined.filter("before IS NULL").withColumn("first", F.lit(None).cast("bigint"))
    each = taken.unionByName(left).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rank = F.col("first") + F.col("copy")
    return each.select("item_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))
