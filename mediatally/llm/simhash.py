"""Near-equal titles: SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediatally.llm.components import smallest_reachable
from mediatally.llm.words import LOWER, U64, Words, free_name, slices, spread, words_of
from mediatally.session import stage

SHINGLE = 3
BUDGET = 3
SEED = 42
UNIT_SIZE = 1 << 18  # fingerprints below one cut node, at most, as long as the cut is not at its deepest
CUT_DEPTHS = (4, 16)
LEAF_PAIRS = 48

# fixed values of the XXH64 hash
P1, P2, P3, P4, P5 = (U64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of byte spans, all spans at once, one step of the hash at a time."""
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    n = len(padded) - 8
    lanes8 = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))
    lanes4 = np.ndarray((n,), dtype="<u4", buffer=padded, strides=(1,))
    seeds = [U64((seed + int(p)) % 2**64) for p in (int(P1) + int(P2), P2, 0, 2**64 - int(P1), P5)]
    h = np.full(len(start), seeds[4], dtype=U64)
    at, left = start.astype(np.int64).copy(), length.astype(np.int64).copy()
    big = np.flatnonzero(left >= 32)
    if len(big):
        p, rest = at[big], left[big]
        acc = [np.full(len(big), v, dtype=U64) for v in seeds[:4]]
        todo = np.arange(len(big))
        while len(todo):
            for k in range(4):
                acc[k][todo] = _round(acc[k][todo], lanes8[p[todo] + 8 * k])
            p[todo] += 32
            rest[todo] -= 32
            todo = todo[rest[todo] >= 32]
        out = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            out = (out ^ _round(np.zeros(1, U64), a)) * P1 + P4
        h[big], at[big], left[big] = out, p, rest
    h += length.astype(U64)
    for _ in range(3):
        go = np.flatnonzero(left >= 8)
        if not len(go):
            break
        h[go] = _rotl(h[go] ^ _round(np.zeros(1, U64), lanes8[at[go]]), 27) * P1 + P4
        at[go] += 8
        left[go] -= 8
    go = np.flatnonzero(left >= 4)
    h[go] = _rotl(h[go] ^ (lanes4[at[go]].astype(U64) * P1), 23) * P2 + P3
    at[go] += 4
    left[go] -= 4
    for _ in range(3):
        go = np.flatnonzero(left > 0)
        if not len(go):
            break
        h[go] = _rotl(h[go] ^ (padded[at[go]].astype(U64) * P5), 11) * P1
        at[go] += 1
        left[go] -= 1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words in lower case with one blank after each, and where each word starts."""
    sizes = words.length + 1
    where = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
    place = spread(words.length)
    out[np.repeat(where, words.length) + place] = LOWER[words.data[np.repeat(words.start, words.length) + place]]
    return out, where


def fingerprints(titles: pa.Array) -> np.ndarray:
    """One unsigned 64-bit fingerprint per title."""
    words = words_of(titles)
    out = np.zeros(len(titles), dtype=U64)
    if not len(words.start):
        return out
    joined, where = _joined(words)
    per_row = np.diff(words.first)
    shingles = np.where(per_row == 0, 0, np.maximum(per_row - SHINGLE + 1, 1))
    head = np.repeat(words.first[:-1], shingles) + spread(shingles)
    tail = head + np.minimum(np.repeat(per_row, shingles), SHINGLE) - 1
    begin = where[head]
    hashes = xxh64(joined, begin, where[tail] + words.length[tail] - begin)
    filled = np.flatnonzero(shingles)
    heads = (np.cumsum(shingles) - shingles)[filled]
    shifts = np.arange(64, dtype=U64)
    for lo in range(0, len(filled), 4096):  # bounds the bit table
        part = filled[lo: lo + 4096]
        a, b = heads[lo], heads[lo] + shingles[part].sum()
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, heads[lo: lo + 4096] - a, axis=0, dtype=np.int32)
        out[part] = ((2 * ones > shingles[part][:, None]).astype(U64) << shifts).sum(axis=1, dtype=U64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "title"):
        marks = pa.array(fingerprints(batch.column(1)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["item_id", "mark"])


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the smallest index of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked_classes(marks: np.ndarray, a: tuple[int, int], b: tuple[int, int], depth: int, budget: int = BUDGET) -> np.ndarray:
    """Class of each of the sorted marks when those within a's range link to those within b's range that differ in
    at most `budget` bits; ranges are trie nodes whose paths of `depth` bits are known.

    Pairs of nodes go down the trie together. A pair holds the bits that already differ and goes on to the pairs of
    children that stay within the budget; pairs whose marks are one class already are left out. Small pairs are
    compared mark by mark. The stack is worked from its top in bounded pieces, so memory does not follow the pairs.
    """
    label = np.arange(len(marks))
    used = int(np.bitwise_count((marks[a[0]] ^ marks[b[0]]) >> U64(64 - depth))) if depth else 0
    stack = [(depth, np.array([[a[0], a[1], b[0], b[1], used]], dtype=np.int64))]
    changes = np.arange(len(marks))
    piece = 1 << 17
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > piece:
            stack.append((depth, pairs[piece:]))
            pairs = pairs[:piece]
        al, ah, bl, bh, used = pairs.T
        one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        pairs = pairs[~one]
        if not len(pairs):
            continue
        al, ah, bl, bh, used = pairs.T
        size = (ah - al) * (bh - bl)
        small = (size <= LEAF_PAIRS) | (depth >= 64)
        if small.any():
            s, sz = pairs[small], size[small]
            k, width = spread(sz), np.repeat(s[:, 3] - s[:, 2], sz)
            x, y = np.repeat(s[:, 0], sz) + k // width, np.repeat(s[:, 2], sz) + k % width
            near = np.bitwise_count(marks[x] ^ marks[y]) <= budget
            if near.any():
                label = _roots(label, x[near], y[near])
                changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            pairs = pairs[~small]
        if not len(pairs):
            continue
        al, ah, bl, bh, used = pairs.T
        bit = U64(63 - depth)
        # children of a node: its range cut where the next bit becomes 1
        ones = np.concatenate([[0], np.cumsum((marks >> bit) & U64(1))]).astype(np.int64)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same_node = al == bl
        cross = [np.stack([al, am, bm, bh, used + 1], 1), np.stack([am, ah, bl, bm, used + 1], 1)[~same_node]]
        alike = [np.stack([al, am, bl, bm, used], 1), np.stack([am, ah, bm, bh, used], 1)]
        for kids in (cross, alike):
            kids = np.concatenate(kids)
            kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)]
            if len(kids):
                stack.append((depth + 1, kids))
    return label


def flips(depth: int, budget: int = BUDGET) -> list[int]:
    """All masks of `depth` bits with at most `budget` ones."""
    return [sum(1 << i for i in ones) for k in range(budget + 1) for ones in combinations(range(depth), k)]


def cut_depth(marks: DataFrame) -> int:
    """The depth at which the trie is cut into pairs of nodes: the least at which no node holds more than UNIT_SIZE marks.

    Reads the number of marks under each of the 65,536 nodes of depth 16, a bounded table.
    """
    least, most = CUT_DEPTHS
    top = marks.groupBy(F.shiftrightunsigned("mark", 64 - most).alias("node")).count().toPandas()
    node, count = top["node"].to_numpy(), top["count"].to_numpy()
    for depth in range(least, most):
        if not len(top) or np.bincount(node >> (most - depth), weights=count).max() <= UNIT_SIZE:
            return depth
    return most


def _links(depth: int):
    def unit(frame: pd.DataFrame) -> pd.DataFrame:
        marks = np.unique(frame["mark"].to_numpy().view(U64))
        nodes = marks >> U64(64 - depth)
        cut = int(np.searchsorted(nodes, nodes[-1]))
        flip = int(frame["flip"].iloc[0])
        if flip and cut == 0:  # one of the two nodes is empty
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        last = (cut, len(marks))
        label = linked_classes(marks, (0, cut) if flip else last, last, depth)
        more = np.flatnonzero(label != np.arange(len(marks)))
        return pd.DataFrame({"a": marks[more].view(np.int64), "b": marks[label[more]].view(np.int64)})

    return unit


def near_links(marks: DataFrame) -> DataFrame:
    """Links `a`, `b` that join all marks within the budget of each other into the same classes.

    The trie is cut at a depth taken from the marks' spread. Every pair of cut nodes whose paths differ in at most
    the budget is one unit of work; it returns a star per class, so fewer links than marks, never all pairs.
    """
    depth = cut_depth(marks)
    node = F.shiftrightunsigned("mark", 64 - depth)
    units = marks.select("mark", node.alias("node"), F.explode(F.array(*[F.lit(m).cast("bigint") for m in flips(depth)])).alias("flip"))
    units = units.withColumn("unit", F.least("node", F.col("node").bitwiseXOR(F.col("flip"))))
    return units.groupBy("unit", "flip").applyInPandas(_links(depth), "a bigint, b bigint")


def similar_titles(items: DataFrame) -> DataFrame:
    """Classes of items whose titles nearly agree.

    `items` needs `item_id` and `title`; other columns are not read. Titles are put in lower case (A to Z only) and cut
    into words and three-word shingles; a title of fewer words is one shingle. A bit of the fingerprint is 1 if it is
    set in over half of the shingles' XXH64 hashes. Fingerprints link at 3 or fewer differing bits. Returns one row
    per input row: `item_id`, `mark` (the fingerprint as a signed long) and `component_id`, the smallest item_id that
    links reach (NULL only if all ids of the class are NULL). Titles that are NULL or without words have fingerprint
    zero and link like any other. Repeated rows and equal titles share a fingerprint. An empty table gives an empty one.

    Equal fingerprints are merged first, so exact copies cost one row. The rest is a self-join of the binary trie of
    the distinct fingerprints, cut into pairs of nodes that Spark deals out; classes come from the links by repeated
    joins. Nothing but the 65,536 node counts reaches the driver.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    marked = items.select("item_id", "title").mapInArrow(_fingerprint_batches, f"item_id {kind}, mark bigint")
    marked = stage(marked, "title-marks")
    marks = stage(marked.groupBy("mark").agg(F.min("item_id").alias("least")), "distinct-marks")
    classes = smallest_reachable(marks.select(F.col("mark").alias("node")), near_links(marks.select("mark")))
    named = marks.join(classes, marks["mark"] == classes["node"]).select("mark", "least", "root")
    named = stage(named, "mark-classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_mark = stage(named.join(least, "root").select("mark", "component_id"), "mark-components")
    return marked.join(of_mark, "mark").select("item_id", "mark", "component_id")


def keep_one(items: DataFrame) -> DataFrame:
    """The rows of `items` with one row of each class of near-equal titles: the smallest id, NULL ids last, then by a hash of the title.

    All columns stay, whatever their names. It is a row that stays, not an id: rows that share an id but not their text belong to
    their own classes, and of rows that repeat id and title one stays. NULL and empty titles are one class. An empty table gives an
    empty one. Titles of any length are read whole.
    """
    row = free_name(items.columns, "row_key")
    key = F.struct(F.col("item_id").isNull().alias("u"), F.col("item_id").alias("id"), F.xxhash64("title").alias("h"))
    # as one text, by which both the join and the last step deal out the rows
    text = lambda of_id, of_title: F.concat_ws("|", of_title.cast("string"), of_id.cast("string"))
    found = similar_titles(items.select(key.alias("item_id"), "title"))
    kept = found.filter("item_id = component_id").select(text(F.col("item_id.id"), F.col("item_id.h")).alias(row)).distinct()
    named = items.withColumn(row, text(F.col("item_id"), F.xxhash64("title"))).join(kept, row, "left_semi")
    return named.dropDuplicates([row]).drop(row)
