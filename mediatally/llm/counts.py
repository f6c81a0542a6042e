"""Token counts of titles: pieces counted once per distinct pre-token, joined to the titles' pre-token frequencies."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mediatally.llm.words import slices, spread, text_bytes
from mediatally.session import stage

LIMIT = 2048
BLOCK_BYTES = 32 << 20  # text of one block, and one more slice of it
BLOCK_TITLES = 1 << 17
HELD = 400_000  # units a task holds; then it starts anew
GLUED = 256  # units that go through the library's pre-tokenizer at once

# a unit of printable ASCII in lower case has these pre-tokens; all others go through the library
PRINTABLE = re.compile(rb"[!-~]+")
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def load(path: str):
    """The tokenizers file at `path`, which must drop white space and lower-case, as word vocabularies with word ends do."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for text in ("Don't stop2day!\n\t  \"A1-b\"", "we'Ve x_y 10.5%"):
        if not tokenizer.normalizer or [p for unit in text.split() for p in PLAIN.findall(unit.lower())] != [p for p, _ in pre_tokens(tokenizer, text)]:
            raise ValueError(f"{path} cuts words in another way: white space must separate and be dropped")
    return tokenizer


def pre_tokens(tokenizer, text: str) -> list[tuple[str, tuple[int, int]]]:
    return tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))


class Cutter:
    """Pre-tokens of titles. Titles are cut into units at ASCII white space, which always ends a pre-token; a unit's
    pre-tokens are found once per task. A unit that contains an added token's string is a pre-token of its own, with a
    blank in front, because the library finds such strings before it normalises the text."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.unit: dict[bytes, int] = {}
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.flat, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _cut(self, units: list[bytes]) -> list[list[str]]:
        cut: list[list[str]] = [[] for _ in units]
        odd = []
        for i, u in enumerate(units):
            if any(a in u for a in self.added):
                cut[i].append(" " + u.decode("utf-8", "replace"))
            elif PRINTABLE.fullmatch(u):
                cut[i] = PLAIN.findall(u.decode().lower())
            else:
                odd.append(i)
        normal = self.tokenizer.normalizer.normalize_str
        for start in range(0, len(odd), GLUED):
            group = odd[start: start + GLUED]
            texts = [normal(units[i].decode("utf-8", "replace")) for i in group]
            ends = np.cumsum([len(t) + 1 for t in texts])
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(texts))
            of = np.searchsorted(ends, [at for _, (at, _) in found], side="right").tolist()
            for k, (piece, _) in zip(of, found):
                cut[group[k]].append(piece)
        return cut

    def _add(self, units: list[bytes]) -> None:
        cut = self._cut(units)
        for u in units:
            self.unit[u] = len(self.unit)
        flat = [p for pieces in cut for p in pieces]
        for p in dict.fromkeys(flat):
            if p not in self.number:
                self.number[p] = len(self.names)
                self.names.append(p)
        self.flat = np.concatenate([self.flat, np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(pieces) for pieces in cut])])

    def frequencies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pre-token's number, title's number, frequency) for every pre-token of every title, some of them more than once."""
        split = [t.split() for t in texts]
        sizes = [len(s) for s in split]
        units = [u for s in split for u in s]
        if not units:
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.fromiter(map(self.unit.get, units, repeat(-1)), np.int64, len(units))
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new = [units[i] for i in missed.tolist()]
            self._add(list(dict.fromkeys(new)))
            at[missed] = np.fromiter(map(self.unit.__getitem__, new), np.int64, len(new))
        pairs, times = np.unique(at * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
        unit, title = pairs // len(texts), pairs % len(texts)
        n = self.first[unit + 1] - self.first[unit]
        piece = self.flat[np.repeat(self.first[unit], n) + spread(n)]
        return piece, np.repeat(title, n), np.repeat(times, n)


class Block:
    """Titles gathered up to a size, with their pre-tokens' frequencies."""

    def __init__(self):
        self.ids: list = []
        self.n_bytes: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, cutter: Cutter, ids: list, texts: list[bytes]) -> None:
        piece, title, times = cutter.frequencies(texts)
        self.parts.append((piece.astype(np.int32), (title + len(self.ids)).astype(np.int32), times.astype(np.int32)))
        self.ids += ids
        self.n_bytes += [len(t) for t in texts]
        self.size += sum(map(len, texts))

    def summed(self, cutter: Cutter) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, how many titles each is in, and per pre-token and title the title's number and the frequency."""
        piece, title, times = (np.concatenate(c).astype(np.int64) for c in zip(*self.parts))
        key = piece * max(len(self.ids), 1) + title
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times[order], heads) if len(key) else times
        piece, title = key[heads] // max(len(self.ids), 1), key[heads] % max(len(self.ids), 1)
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, np.int64)
        return [cutter.names[p] for p in piece[starts].tolist()], np.diff(np.r_[starts, len(piece)]), title, times


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small non-negative numbers, byte plane by byte plane, compressed."""
    parts = []
    for a in arrays:
        width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        parts += [struct.pack("<BQ", width, len(a)), planes.tobytes()]
    raw = b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    arrays, at = [], 0
    while at < len(raw):
        width, n = struct.unpack_from("<BQ", raw, at)
        at += struct.calcsize("<BQ")
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        arrays.append(sum(planes[k].astype(np.int64) << (8 * k) for k in range(width)))
        at += width * n
    return arrays


def _blocks(path: str, id_type: pa.DataType):
    names = ["block", "ids", "n_bytes", "pre_tokens", "frequencies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, task, made = Cutter(path), TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            pieces, counts, title, times = block.summed(cutter)
            # numbers of a pre-token's titles as steps from one to the next
            heads = np.cumsum(counts) - counts
            steps = np.diff(title, prepend=0)
            steps[heads] = title[heads]
            columns = [[(task << 32) + made], [block.ids], [block.n_bytes], [pieces], [packed(counts, steps, times - 1)]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        block = Block()
        for batch in slices(batches, "title"):
            data, at = text_bytes(batch.column(1))
            whole, ends = data.tobytes(), at.tolist()
            block.add(cutter, batch.column(0).to_pylist(), [whole[a:b] for a, b in zip(ends, ends[1:])])
            if block.size >= BLOCK_BYTES or len(block.ids) >= BLOCK_TITLES:
                yield out()
                block, made = Block(), made + 1
                if len(cutter.unit) > HELD:
                    cutter.clear()
        if block.ids:
            yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        model = tokenizer.model
        for batch in batches:
            n = [len(tokenizer.encode(p[1:], add_special_tokens=False).ids) if p[0] == " " else len(model.tokenize(p))
                 for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["pre_token", "pieces"])

    return run


def _sums(block: pa.Table, pieces: pa.Table) -> pa.Table:
    """Tokens of one block's titles from its frequencies and the pieces of its pre-tokens."""
    counts, steps, times = unpacked(block["frequencies"][0].as_py())
    ids, n_bytes = block["ids"].combine_chunks().flatten(), block["n_bytes"].combine_chunks().flatten()
    total = np.zeros(len(ids), np.int64)
    if len(counts):
        each = np.zeros(len(counts), np.int64)
        each[pieces["pos"].to_numpy()] = pieces["pieces"].to_numpy()
        heads = np.cumsum(counts) - counts
        sums = np.cumsum(steps)
        title = sums - np.repeat(sums[heads] - steps[heads], counts)
        total += np.bincount(title, weights=(times + 1) * np.repeat(each, counts), minlength=len(total)).astype(np.int64)
    return pa.table({"item_id": ids, "n_bytes": n_bytes, "n_tokens": pa.array(total)})


def title_tokens(items: DataFrame, *, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of every title as the tokenizers library counts them, without ids.

    `items` needs `item_id` and `title`; other columns are not read, whatever their names. `tokenizer` is the path of a
    tokenizers file on every executor, of a word vocabulary that drops white space (others raise ValueError). Returns
    one row per input row: `item_id`, `n_bytes` (UTF-8), `n_tokens` and `over_limit` (n_tokens > limit). No special
    tokens are added; strings of special tokens inside a title are one token each, the library's default. NULL, empty
    and blank titles have no tokens. Repeated rows and NULL ids each get their own result; an empty table gives an
    empty one. Titles of any length are counted whole, one title in one task.

    Titles are taken in blocks of bounded text. A block is one row with its distinct pre-tokens and, packed, the titles each
    is in and how often; a pre-token that all titles share occurs once per block. The library's model sees every
    distinct pre-token of the corpus once. The join of counts and pre-tokens runs between two written tables, where Spark
    splits a hot pre-token; it moves a block number and a place, and the frequencies only meet the counts in the end.
    """
    id_type = items.schema["item_id"].dataType
    ids = id_type.simpleString()
    cut = items.select("item_id", "title").mapInArrow(
        _blocks(tokenizer, to_arrow_type(id_type)),
        f"block bigint, ids array<{ids}>, n_bytes array<bigint>, pre_tokens array<string>, frequencies binary")
    cut = stage(cut, "title-pre-tokens")
    distinct = cut.select(F.explode("pre_tokens").alias("pre_token")).distinct()
    pieces = stage(distinct.mapInArrow(_pieces(tokenizer), "pre_token string, pieces bigint"), "pre-token-pieces")
    placed = cut.select(F.col("block").alias("of"), F.posexplode("pre_tokens").alias("pos", "pre_token"))
    counted = placed.join(pieces, "pre_token").select("of", "pos", "pieces")
    held = cut.select("block", "ids", "n_bytes", "frequencies")
    summed = held.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_sums, f"item_id {ids}, n_bytes bigint, n_tokens bigint")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
