"""Reserved texts inside titles, found by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mediatally.llm.words import NO_TOKEN, U64, free_name, run_hashes, slices, spread, word_hashes, words_of

SEED_TOKENS = 5
COVERAGE = 0.5
BLOCK_BYTES = 4 << 20  # reserved text that is sent to the executors at a time
_POWER = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every n consecutive tokens, each from the one before it by one multiplication."""
    up = np.multiply.accumulate(np.full(len(tokens), _POWER, U64))
    down = np.multiply.accumulate(np.full(len(tokens), _INVERSE, U64))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(tokens * up)])
    return (sums[n:] - sums[:-n]) * down[: len(tokens) - n + 1]


def tile(title: np.ndarray, reserved: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in title, place in reserved, length): the longest common runs of tokens that do not overlap, longest
    first, ties by place in title, then in reserved, down to `least` tokens. Equal hashes are checked token by token."""
    free_t, free_r = np.ones(len(title), bool), np.ones(len(reserved), bool)
    tiles = []
    n = min(len(title), len(reserved))
    while n >= least:
        def whole(free: np.ndarray) -> np.ndarray:
            held = np.concatenate([[0], np.cumsum(free)])
            return np.flatnonzero(held[n:] - held[:-n] == n)

        at_t, at_r = whole(free_t), whole(free_r)
        places = defaultdict(list)
        if len(at_t) and len(at_r):
            hashes = _rolling(reserved, n)
            for j in at_r.tolist():
                places[int(hashes[j])].append(j)
            hashes = _rolling(title, n)[at_t]
            near = np.isin(hashes, np.fromiter(places, dtype=U64, count=len(places)))
            for i, h in zip(at_t[near].tolist(), hashes[near].tolist()):
                for j in places[h]:
                    if free_t[i: i + n].all() and free_r[j: j + n].all() and (title[i: i + n] == reserved[j: j + n]).all():
                        free_t[i: i + n] = free_r[j: j + n] = False
                        tiles.append((i, j, n))
                        break
        n -= 1
    return tiles


@dataclass
class Reserved:
    """Reserved texts of one block: `ids`, their token hashes, and their seeds, sorted by hash, by seed length."""

    ids: list
    tokens: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index_reserved(ids: list, texts: pa.Array) -> Reserved:
    words = words_of(texts, NO_TOKEN)
    hashes = word_hashes(words)
    tokens = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    found = defaultdict(lambda: ([], [], []))
    for k, own in enumerate(tokens):
        n = min(SEED_TOKENS, len(own))
        if n:
            seed = run_hashes(own, n)
            for held, new in zip(found[n], (seed, np.full(len(seed), k), np.arange(len(seed)))):
                held.append(new)
    seeds = {}
    for n, parts in found.items():
        h, item, place = (np.concatenate(p) for p in parts)
        order = np.argsort(h, kind="stable")
        seeds[n] = (h[order], item[order], place[order])
    return Reserved(ids, tokens, seeds)


def matches(titles: pa.Array, reserved: Reserved, coverage: float = COVERAGE) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(title row, index of the reserved text, covered share of it, tiles) for every pair with enough of it covered."""
    words = words_of(titles, NO_TOKEN)
    if not len(words.start):
        return []
    hashes, row = word_hashes(words), words.row
    hits = defaultdict(set)
    for n, (seeds, item, place) in reserved.seeds.items():
        runs = run_hashes(hashes, n)
        if not len(runs):
            continue
        # a bitmap of the seeds' low bits spares most runs the search
        low = np.zeros(1 << 20, bool)
        low[(seeds & U64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(runs & U64((1 << 20) - 1)).astype(np.int64)] & (row[: len(runs)] == row[n - 1:]))
        lo = np.searchsorted(seeds, runs[maybe], "left")
        many = np.searchsorted(seeds, runs[maybe], "right") - lo
        which = np.repeat(lo, many) + spread(many)
        pairs = np.unique(np.stack([np.repeat(row[maybe], many), item[which], place[which]], 1), axis=0)
        for r, k, p in pairs.tolist():
            hits[r, k].add((p, n))
    out = []
    for (r, k), seeds in sorted(hits.items()):
        own = reserved.tokens[k]
        covered = np.zeros(len(own), bool)
        for p, n in seeds:
            covered[p: p + n] = True
        if covered.sum() < coverage * len(own):  # tiles lie within shared seeds
            continue
        tiles = tile(hashes[words.first[r]: words.first[r + 1]], own, min(SEED_TOKENS, len(own)))
        share = sum(t[2] for t in tiles) / len(own)
        if share >= coverage:
            out.append((r, k, share, tiles))
    return out


def _blocks(reserved: DataFrame) -> Iterator[Reserved]:
    """The reserved texts in blocks of at most BLOCK_BYTES on average, one at a time on the driver."""
    texts = reserved.select("reserved_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    block = F.pmod(F.xxhash64("reserved_id", "text"), F.lit(blocks))
    for b in range(blocks):
        part = texts.filter(block == b).orderBy("reserved_id", "text").collect()
        yield index_reserved([r[0] for r in part], pa.array([r[1] for r in part], pa.string()))


def reserved_in_titles(items: DataFrame, reserved: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """Titles that hold a reserved text, whole or in reordered pieces.

    The project has no table of reserved texts, so `reserved` is general: `reserved_id` and `text`, such as test items
    that must not be trained on. `items` needs `item_id` and `title`. Tokens are runs of letters and digits in lower
    case. Titles and reserved texts that share five tokens in a row (all of them, if a reserved text has fewer) are
    tiled: the longest common runs are marked first and no token is used twice. Returns one row per pair of which
    the tiles cover at least `coverage` of the reserved text's tokens: `item_id`, `reserved_id`, `coverage`, `tiles`
    and `spans` (first token and number of tokens in the title, by place). Reserved texts without a token match
    nothing; NULL titles match nothing. Repeated titles each have their rows, and so have repeated reserved texts.
    Empty tables give an empty one.

    Titles are read once per block of reserved texts; a block's size has a bound, and it is what is sent to the
    executors. No title moves and no pairs are formed but those that share a seed.
    """
    out = None
    for index in _blocks(reserved):
        found = _pairs(items, index, reserved.schema["reserved_id"].dataType, coverage)
        out = found if out is None else out.unionByName(found)
    return out


def _pairs(items: DataFrame, index: Reserved, kind, coverage: float) -> DataFrame:
    given = items.sparkSession.sparkContext.broadcast(index)
    rows = items.select("item_id", F.lower("title").alias("title"))
    schema = (f"item_id {items.schema['item_id'].dataType.simpleString()}, reserved_id {kind.simpleString()}, coverage double, "
              "tiles bigint, spans array<struct<start: bigint, tokens: bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, id_type = given.value, to_arrow_type(kind)
        for part in slices(batches, "title"):
            found = matches(part.column(1), index, coverage)
            tiles = [[{"start": i, "tokens": n} for i, _, n in sorted(f[3])] for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([index.ids[f[1]] for f in found], id_type),
                 pa.array([f[2] for f in found], pa.float64()), pa.array([len(f[3]) for f in found], pa.int64()),
                 pa.array(tiles, pa.list_(pa.struct([("start", pa.int64()), ("tokens", pa.int64())])))],
                names=["item_id", "reserved_id", "coverage", "tiles", "spans"])

    return rows.mapInArrow(run, schema)


def without_reserved(items: DataFrame, reserved: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `items` whose title holds no reserved text; see `reserved_in_titles`. All columns stay, whatever their
    names, and no row moves. NULL and empty titles stay; repeated rows stay or go alike; an empty table on either side drops nothing."""
    for index in _blocks(reserved):
        items = _clean(items, index, coverage)
    return items


def _clean(items: DataFrame, index: Reserved, coverage: float) -> DataFrame:
    given = items.sparkSession.sparkContext.broadcast(index)
    names = items.columns
    lower = free_name(names, "_lower")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, lower):
            keep = np.ones(part.num_rows, bool)
            keep[[f[0] for f in matches(part.column(len(names)), given.value, coverage)]] = False
            yield part.select(names).filter(pa.array(keep))

    return items.withColumn(lower, F.lower("title")).mapInArrow(run, items.schema)
