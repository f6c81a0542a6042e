"""Masked pseudo-likelihood of titles under a bidirectional window network."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from mediatally.llm.words import LOWER, U64, Words, slices, spread, word_hashes, words_of
from mediatally.session import stage

REACH = 2  # words to each side
HIDDEN = 16
CLASSES = 32  # at least, and as many tokens per class as classes
PER_CLASS = 32
VOCABULARY = CLASSES * PER_CLASS
SHARED = 4  # one token in so many is shared by rare words
OFTEN = 4  # a word is frequent from sqrt(words of all titles) / OFTEN times on
EDGE = VOCABULARY  # stands outside of the title; of a larger vocabulary its size
BLOCK = 1 << 14  # parameters averaged together
ROUNDS = 2
BATCH = 8192
RATE = 0.15
SEED = 7


@dataclass
class Vocabulary:
    """Hashes of the frequent words, sorted, and the token of each. Tokens are dealt over `side` classes of `side` tokens by
    rank, so that classes are about equally frequent. `totals` holds how often rare words of each shared token occur."""

    hashes: np.ndarray
    tokens: np.ndarray
    side: int
    totals: np.ndarray

    @property
    def size(self) -> int:
        return self.side * self.side

    def encode(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token of each word, its shared token's number or -1)."""
        shared = hashes.view(np.int64) % len(self.totals)
        rare = dealt(self.size - len(self.totals) + shared, self.side)
        if not len(self.hashes):
            return rare, shared
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        own = self.hashes[at] == hashes
        return np.where(own, self.tokens[at], rare), np.where(own, -1, shared)


def dealt(rank: np.ndarray, side: int) -> np.ndarray:
    return (rank % side) * side + rank // side


def _hashed(titles: pa.Array) -> tuple[Words, np.ndarray]:
    words = words_of(titles)
    words = Words(LOWER[words.data], words.start, words.length, words.first)
    return words, word_hashes(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, times = np.zeros(0, U64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(times)], names=["word", "n"])

    waiting: list[np.ndarray] = []
    for batch in slices(batches, "title"):
        waiting.append(_hashed(batch.column(0))[1])
        if sum(map(len, waiting)) > 1 << 21:
            held, times = _merged(held, times, waiting)
            waiting = []
            if len(held) > 1 << 21:  # bounds the memory; parts are summed up again later
                yield out()
                held, times = np.zeros(0, U64), np.zeros(0, np.int64)
    held, times = _merged(held, times, waiting)
    yield out()


def _merged(held: np.ndarray, times: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, counts = np.unique(np.concatenate([np.zeros(0, U64), *more]), return_counts=True)
    both, n = np.concatenate([held, new]), np.concatenate([times, counts])
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    return both[first], (np.add.reduceat(n, first) if len(first) else n)


def learn_vocabulary(items: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and `word` and `n` of all rare words that occur more than once.

    Every word is counted over all titles. Words that occur sqrt(all)/OFTEN times or more, so at most OFTEN * sqrt(all)
    words, and those that fill up the classes get tokens of their own; only they and the totals reach the driver.
    """
    counts = items.select("title").mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "word-counts")
    often = math.isqrt(counts.agg(F.sum("n")).first()[0] or 0) // OFTEN + 1
    frequent = counts.filter(F.col("n") >= often).count()
    side = max(CLASSES, math.isqrt(frequent * SHARED // (SHARED - 1)) + 1)
    shared = side * side // SHARED
    top = counts.orderBy(F.desc("n"), "word").limit(side * side - shared).toPandas()
    rare = counts.filter("false")
    if len(top) == side * side - shared:
        n, word = int(top["n"].iloc[-1]), int(top["word"].iloc[-1])
        rare = counts.filter((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
    sums = rare.groupBy(F.pmod("word", F.lit(shared)).alias("token")).agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(shared, np.int64)
    totals[sums["token"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    hashes = top["word"].to_numpy(dtype=np.int64).view(U64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], dealt(np.arange(len(hashes)), side)[order], side, totals), rare.filter("n > 1")


@dataclass
class Network:
    """Token at place t from the tokens around it: tanh of the sum of one vector per place and token, then the class of
    the token, then the token among its class."""

    around: np.ndarray  # place, token, hidden
    class_w: np.ndarray
    class_b: np.ndarray
    word_w: np.ndarray  # class, hidden, token of the class
    word_b: np.ndarray

    @staticmethod
    def new(side: int = CLASSES) -> Network:
        rng = np.random.default_rng(SEED)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return Network(small(2 * REACH, side * side + 1, HIDDEN), small(HIDDEN, side), np.zeros(side, np.float32),
                       small(side, HIDDEN, side), np.zeros((side, side), np.float32))

    @property
    def side(self) -> int:
        return len(self.class_b)

    def parts(self) -> list[np.ndarray]:
        return [self.around, self.class_w, self.class_b, self.word_w, self.word_b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at: at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def hidden(self, places: list[np.ndarray]) -> np.ndarray:
        total = self.around[0].take(places[0], axis=0)
        for k in range(1, 2 * REACH):
            total += self.around[k].take(places[k], axis=0)
        return np.tanh(total, out=total)

    def by_class(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, list[int]]:
        """The order of the tokens by class, and in that order the tokens at each place around, each token's class and its
        number in it, and where the classes start."""
        group = token // self.side
        order = _order(group, self.side)
        group = group[order]
        places = [context[:, k].take(order) for k in range(2 * REACH)]
        return order, places, group, token[order] - group * self.side, np.searchsorted(group, np.arange(self.side + 1)).tolist()

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        order, places, group, member, cuts = self.by_class(context, token)
        h, at = self.hidden(places), np.arange(len(token))
        z = self.class_w.T @ h.T + self.class_b[:, None]
        each = z[group, at] - _log_sum(z)
        for c in range(self.side):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                z = self.word_w[c].T @ h[a:b].T + self.word_b[c][:, None]
                each[a:b] += z[member[a:b], at[: b - a]] - _log_sum(z)
        out = np.empty(len(token), np.float32)
        out[order] = each
        return out


# choices are rows and words columns from here on, so that maxima and sums run over whole rows at a time
def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=0)
    z = z - top
    return np.log(np.exp(z, out=z).sum(axis=0)) + top


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def _order(numbers: np.ndarray, most: int) -> np.ndarray:
    """A stable order; numpy sorts 16-bit numbers by radix."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


class Trainer:
    """Gradient steps with a rate per parameter that falls with its past gradients."""

    def __init__(self, network: Network):
        self.net = network
        self.past = [np.full(p.shape, 1e-3, np.float32) for p in network.parts()]

    def _move(self, k: int, grad: np.ndarray) -> None:
        past = self.past[k]
        past += grad * grad
        grad *= RATE
        grad /= np.sqrt(past)
        self.net.parts()[k][...] -= grad

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        net, n = self.net, len(token)
        _, places, group, member, cuts = net.by_class(context, token)
        h, at = net.hidden(places), np.arange(n)
        err = _softmax(net.class_w.T @ h.T + net.class_b[:, None])
        err[group, at] -= 1
        back = net.class_w @ err
        word_w, word_b = np.zeros_like(net.word_w), np.zeros_like(net.word_b)
        for c in range(net.side):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                part = h[a:b]
                e = _softmax(net.word_w[c].T @ part.T + net.word_b[c][:, None])
                e[member[a:b], at[: b - a]] -= 1
                back[:, a:b] += net.word_w[c] @ e
                np.matmul(part.T, e.T, out=word_w[c])
                e.sum(axis=1, out=word_b[c])
        back = np.ascontiguousarray(back.T)
        back *= (1 - h * h) / n
        self._move(1, h.T @ err.T / n)
        self._move(2, err.mean(axis=1))
        self._move(3, word_w / n)
        self._move(4, word_b / n)
        for k, held in enumerate(places):
            by = _order(held, net.side * net.side + 1)
            held = held[by]
            heads = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            grad, where = np.add.reduceat(back.take(by, axis=0), heads, axis=0), held[heads]
            past = self.past[0][k].take(where, axis=0)
            past += grad * grad
            self.past[0][k][where] = past
            grad *= RATE
            grad /= np.sqrt(past, out=past)
            net.around[k][where] -= grad


def contexts(tokens: np.ndarray, first: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The tokens at the places around every token of its title; `edge` outside of it."""
    counts = np.diff(first)
    gap = np.full(len(tokens) + REACH * (len(counts) + 1), edge, np.int64)
    place = np.arange(len(tokens)) + REACH * (1 + np.repeat(np.arange(len(counts)), counts))
    gap[place] = tokens
    return np.stack([gap[place + d] for d in (*range(-REACH, 0), *range(1, REACH + 1))]).T  # a place's tokens lie together


def _round_of() -> Column:
    return F.pmod(F.xxhash64("title"), F.lit(ROUNDS))


def _train(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = given.value
        trainer = Trainer(Network.new(words.side).filled(flat))
        seen = 0
        for batch in slices(batches, "title"):
            found, hashes = _hashed(batch.column(0))
            tokens, _ = words.encode(hashes)
            around = contexts(tokens, found.first, words.size)
            seen += len(tokens)
            for a in range(0, len(tokens), BATCH):
                trainer.step(around[a: a + BATCH], tokens[a: a + BATCH])
        if seen:
            new = trainer.net.flat()
            heads = range(0, len(new), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a // BLOCK for a in heads], pa.int32()), pa.array([new[a: a + BLOCK].tobytes() for a in heads], pa.binary()),
                 pa.array([seen] * len(heads), pa.int64())], names=["block", "parameters", "weight"])

    return run


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) * w for p, w in zip(rows["parameters"], rows["weight"]))
    return pd.DataFrame({"block": rows["block"].iloc[:1], "parameters": [(total / rows["weight"].sum()).astype(np.float32).tobytes()]})


def learn_network(items: DataFrame, words: Vocabulary) -> Network:
    """A network trained on all titles. The titles are split into rounds by a hash; in each round every task trains on
    from the same network over its titles, and the results are averaged, weighted by words, parameter by parameter."""
    network = Network.new(words.side)
    titles = items.select("title")
    for r in range(ROUNDS):
        given = items.sparkSession.sparkContext.broadcast((words, network.flat()))  # bounded by the vocabulary
        parts = titles.filter(_round_of() == r).mapInArrow(_train(given), "block int, parameters binary, weight bigint")
        mean = parts.groupBy("block").applyInPandas(_mean, "block int, parameters binary").toPandas().sort_values("block")
        if len(mean):
            network = network.filled(np.frombuffer(b"".join(map(bytes, mean["parameters"])), np.float32))
    return network


def _scores(given):
    """Per title the likelihood of its tokens, and with a rare word's share within its token still without the word's
    count; the rare words are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = given.value
        network = Network.new(words.side).filled(flat)
        log_totals = np.log(np.maximum(words.totals, 1))
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "title"):
            found, hashes = _hashed(batch.column(1))
            tokens, shared = words.encode(hashes)
            around = contexts(tokens, found.first, words.size)
            parts = [network.log_probabilities(around[a: a + 2 * BATCH], tokens[a: a + 2 * BATCH]) for a in range(0, len(tokens), 2 * BATCH)]
            each = np.concatenate([np.zeros(0), *parts])
            rare = shared >= 0
            each[rare] -= log_totals[shared[rare]]
            sums = np.concatenate([[0.0], np.cumsum(each)])
            n = np.diff(found.first)
            total = sums[found.first[1:]] - sums[found.first[:-1]]
            at = np.concatenate([[0], np.cumsum(rare)])[found.first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes[rare].view(np.int64)))],
                names=["row", "item_id", "n_words", "total", "rare"])
            row += len(n)

    return run


def title_likelihood(items: DataFrame) -> DataFrame:
    """The pseudo-log-likelihood of every title under a network trained on all titles of `items`.

    `items` needs `item_id` and `title`; other columns are not read. Words are put in lower case (A to Z). Frequent ones
    are tokens of their own, the others share hashed ones; both kinds of token grow with the titles. A rare word's
    probability is that of its token times the word's share of all occurrences of the token's words, so every word has
    a probability of its own. Every word is predicted from the two words on each side of it; `log_likelihood` is the sum
    of the log-probabilities, `per_word` their mean and `n_words` their number. NULL and empty titles have no words and
    0 in all three. Repeated rows each get the result. An empty table gives an empty one. Word counts and training cover
    all titles; what reaches the driver is the list of frequent words, at most OFTEN times the root of the number of all
    words or the least vocabulary, and the network's parameters. Rare words meet their counts by a join; no step moves
    titles.
    """
    words, rare = learn_vocabulary(items)
    network = learn_network(items, words)
    given = items.sparkSession.sparkContext.broadcast((words, network.flat()))
    kind = items.schema["item_id"].dataType.simpleString()
    scored = stage(items.select("item_id", "title").mapInArrow(
        _scores(given), f"row bigint, item_id {kind}, n_words bigint, total double, rare array<bigint>"), "title-scores")
    met = scored.select("row", F.explode("rare").alias("word")).join(rare, "word")
    more = met.groupBy("row").agg(F.sum(F.log("n")).alias("more"))  # log 1 is 0: words that occur once are left out
    total = F.least(F.col("total") + F.coalesce("more", F.lit(0.0)), F.lit(0.0))
    return scored.join(more, "row", "left").select("item_id", "n_words", total.alias("log_likelihood")).select(
        "*", (F.col("log_likelihood") / F.greatest("n_words", F.lit(1))).alias("per_word"))
