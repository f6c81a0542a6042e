"""Titles as files of token ids: frequency ranks in a byte-aligned variable-length code.

File format. A file is a sequence of blocks; a block holds whole titles:

    magic "MTI1" | five unsigned 32-bit numbers: titles, ids, ranks, width of a table entry, data bytes
    rank table   | ranks entries of 2 or 4 bytes: the id of rank 0, 1, …, most frequent id of the block first
    lengths      | titles x unsigned 32-bit: ids per title, end id included
    names        | titles x unsigned 32-bit: bytes of the title's item_id as text (2^32 - 1: NULL), then these texts
    control      | one byte for 4 ids, two bits each: bytes of the id's rank, less one (first id in the low bits)
    data         | the ranks, little-endian, 1 to 4 bytes each
    line feed

All numbers are little-endian. Titles of all blocks of all files, by part number, are in ascending id order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mediatally.llm.words import slices, spread
from mediatally.session import scratch_dir, stage

MAGIC = b"MTI1"
HEAD = "<4s5I"
END_ID = 0
NO_NAME = 2**32 - 1
BLOCK_IDS = 1 << 20
CACHED = 150_000  # pieces of texts a worker holds; then it keeps at most two thirds, those used most

GLUED = 32  # new pieces in one text; longer texts cost the library more per piece

# a run of blanks and line feeds with the run of other characters after it is tokenized on its own
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# UTF-8 of other white space, or of characters near it, next to which a cut could change the tokens
ODD_BYTES = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
ODD_PARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# a run of these at a unit's end is a token boundary of its own after a letter or digit; not so the apostrophe
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SLICE_BYTES = 3 << 20  # of texts taken at once: the fewer slices, the fewer look-ups of the same unit, but the more memory

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # by control byte


def cut(text: str) -> str | list[str] | None:
    """The text's units, cut at blanks and line feeds, the separator with what follows. A blank in front is left out, so
    that a unit stands for itself if it starts with a blank or line feed, and else for blank and unit. A line feed is put
    in front of a text that starts with neither. A text without runs of separators comes as a string to be split at
    blanks. None if the text has other white space."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw.translate(None, ODD_BYTES)) != len(raw) or not raw.isascii() and any(p in raw for p in ODD_PARTS):
        return None
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n", "") or text[-1] in " \n":
        units = UNIT.findall(text if text[:1] in (" ", "\n", "") else "\n" + text)
        return [u[1:] if u[0] == " " and len(u) > 1 and u[1] not in " \n" else u for u in units]
    return "\n" + text.replace("\n", " \n")


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def without_marks(units: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, pa.LargeStringArray]:
    """(the units without the marks at their end, the places of those that had some, these marks). Marks stay where they
    do not follow an ASCII letter or digit, or a letter from U+00C0 to U+023F: only there a token surely ends."""
    bare = pc.ascii_rtrim(units, characters=MARKS)
    sizes, kept = (pc.binary_length(x).to_numpy() for x in (units, bare))
    at = np.flatnonzero((kept > 0) & (kept < sizes))
    _, ends, data = units.buffers()
    start = np.frombuffer(ends, np.int64, len(units) + 1, 8 * units.offset)[at]
    data = np.frombuffer(data, np.uint8)
    last, before = data[start + kept[at] - 1], data[np.maximum(start + kept[at] - 2, 0)]
    folded = last | 0x20
    ascii_ok = (last < 0x80) & ((folded >= 0x61) & (folded <= 0x7A) | (last >= 0x30) & (last <= 0x39))
    wide_ok = (last >= 0x80) & (last < 0xC0) & (before >= 0xC3) & (before <= 0xC8) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    ok = ascii_ok | wide_ok
    at, start = at[ok], start[ok]
    left = sizes[at] - kept[at]
    marks = data[np.repeat(start + kept[at], left) + spread(left)]
    marks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(left)])), pa.py_buffer(marks))
    cuts = np.zeros(len(units), bool)
    cuts[at] = True
    return pc.if_else(pa.array(cuts), bare, units), at, marks


class Encoder:
    """Ids of texts by a tokenizers file. Texts are cut into units at blanks, which are token boundaries of a byte-level
    vocabulary that starts words with the blank, and units once more before the marks at their end. Each distinct unit of
    a call is looked up once; pieces not seen before are encoded together."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library finds the strings of added tokens before it cuts words, so texts that hold one are encoded whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            sizes[i] = len(token)  # one character per byte
        self.bytes_of = sizes
        self.clear()

    def clear(self) -> None:
        self.numbers = count()
        self.number = defaultdict(self.numbers.__next__)  # of pieces, in the order they are first asked for
        self.flat = np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each piece's ids in `flat`
        self.uses = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keep the pieces used more than once since the last time, at most two thirds of what fits, the most used ones."""
        kept, most = np.flatnonzero(self.uses > 1), CACHED * 2 // 3
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[:most]])
        units, sizes = list(self.number), self.size[kept]
        flat = self.flat[np.repeat(self.start[kept], sizes) + spread(sizes)]
        uses = self.uses[kept] // 2  # so that pieces of earlier texts only go in time
        self.clear()
        self.number.update(zip([units[i] for i in kept.tolist()], self.numbers))
        self.flat, self.start, self.size, self.uses = flat, np.cumsum(sizes) - sizes, sizes, uses

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _add(self, units: list[str]) -> None:
        """Encode new pieces. Those that stand for blank and piece are put into one text, and so are those of a line feed
        and a piece: a token never spans two of them."""
        kinds = np.array([1 if u[0] not in " \n" else 2 if u[0] == "\n" and u[1:2] not in ("", " ", "\n") else 0 for u in units], np.int8)
        parts, placed, sizes = [], [], []
        for kind, gap, mark in ((1, " ", 0x20), (2, "", 0x0A)):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            glued = [units[i] for i in own.tolist()] if len(own) < len(units) else units
            texts = [gap + gap.join(glued[i: i + GLUED]) for i in range(0, len(glued), GLUED)]
            done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(d.ids for d in done), np.uint32)
            # a piece ends where the next one's blank or line feed stands; pieces themselves hold no other
            raw = "".join(texts).encode("utf-8", "surrogatepass")
            ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == mark)[1:], len(raw))
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1, prepend=0))
            parts.append(ids)
            placed.append(own)
        alone = np.flatnonzero(kinds == 0)
        found = [done.ids for done in self.tokenizer.encode_batch_fast([units[i] for i in alone.tolist()], add_special_tokens=False)]
        parts.append(np.array([i for ids in found for i in ids], dtype=np.uint32))
        placed, sizes = np.concatenate([*placed, alone]), np.concatenate([*sizes, np.array([len(ids) for ids in found], np.int64)])
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        start[placed], size[placed] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        self.flat = np.concatenate([self.flat, *parts])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def _of_units(self, units: pa.LargeStringArray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct units one after another, ids per unit); a unit occurs so many `times`."""
        bare, at, marks = without_marks(units)
        bare, marks = bare.dictionary_encode(), marks.dictionary_encode()
        # marks in the middle of a unit have no blank in front: they are looked up after a line feed, whose id is left out
        asked = strings(bare.dictionary) + ["\n" + m for m in strings(marks.dictionary)]
        number = np.fromiter(map(self.number.__getitem__, asked), np.int64, len(asked))
        new = len(self.number) - len(self.size)
        if new:
            self._add(list(islice(reversed(self.number), new))[::-1])
        first = number[bare.indices.to_numpy()]
        last = number[len(bare.dictionary):][marks.indices.to_numpy()]
        uses = np.bincount(np.concatenate([first, last]), np.concatenate([times, times[at]]), len(self.number)).astype(np.int64)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        start, size = np.zeros((len(units), 2), np.int64), np.zeros((len(units), 2), np.int64)
        start[:, 0], size[:, 0] = self.start[first], self.size[first]
        start[at, 1], size[at, 1] = self.start[last] + 1, self.size[last] - 1
        return self.flat[np.repeat(start.ravel(), size.ravel()) + spread(size.ravel())], size.sum(axis=1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        if len(self.number) > CACHED:
            self.shrink()
        cuts = [None if any(a in t for a in self.added) else cut(t) for t in texts]
        split = [i for i, c in enumerate(cuts) if isinstance(c, str)]
        listed = [i for i, c in enumerate(cuts) if isinstance(c, list)]
        whole = [i for i, c in enumerate(cuts) if c is None]
        counts = np.ones(len(texts), np.int64)
        units = pc.split_pattern(pa.array([cuts[i] for i in split], pa.large_string()), " ")
        counts[split], counts[listed] = pc.list_value_length(units).to_numpy(), [len(cuts[i]) for i in listed]
        units = units.flatten()
        if listed:
            units = pa.concat_arrays([units, pa.array(list(chain.from_iterable(cuts[i] for i in listed)), pa.large_string())])
        units = units.dictionary_encode()
        bare = [i for i, c in enumerate(cuts) if c and texts[i][0] not in " \n"]
        del cuts  # as large as the texts
        at, n = units.indices.to_numpy(), len(units.dictionary)
        table, size = self._of_units(units.dictionary, np.bincount(at, minlength=n))
        # texts with other white space are units of their own
        own = [self.plain(texts[i]) for i in whole]
        table, size = np.concatenate([table, *own]), np.concatenate([size, np.array([len(ids) for ids in own], np.int64)])
        at = np.concatenate([at, np.arange(n, n + len(own))])
        start, size = (np.cumsum(size) - size)[at], size[at]
        placed = np.array([*split, *listed, *whole], np.int64)
        begin = np.zeros(len(texts), np.int64)
        begin[placed] = np.cumsum(counts[placed]) - counts[placed]
        # the line feed in front of a text is not its own
        heads = begin[bare]
        start[heads] += 1
        size[heads] -= 1
        if len(split) < len(texts):
            order = np.repeat(begin, counts) + spread(counts)
            start, size = start[order], size[order]
        ends = np.concatenate([[0], np.cumsum(size)])
        firsts = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(start - ends[:-1], size)
        places += np.arange(ends[-1])
        return table[places], np.diff(ends[firsts])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file. Functions and their modules are sent anew with every task, so it is kept with the
    installed library's module, which outlives the task, and with it the units seen so far."""
    import tokenizers

    held = vars(tokenizers).setdefault("_encoders_by_path", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def write_block(ids: np.ndarray, lengths: np.ndarray, names: list[bytes | None]) -> bytes:
    """One block: `ids` of titles with `lengths` ids and `names` each."""
    if len(ids) >= 2**32 or len(lengths) >= 2**32:
        raise ValueError("a block holds fewer than 2^32 ids")
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank[ids]
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    start = ends - size
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[start] = ranks & np.uint32(255)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            data[start[more] + k] = (ranks[more] >> np.uint32(8 * k)) & np.uint32(255)
    width = 2 if len(counts) <= 1 << 16 else 4
    return b"".join([struct.pack(HEAD, MAGIC, len(lengths), len(ids), len(table), width, len(data)), table.astype(f"<u{width}").tobytes(),
                     lengths.astype("<u4").tobytes(), np.array([NO_NAME if x is None else len(x) for x in names], dtype="<u4").tobytes(),
                     *[x for x in names if x], control.tobytes(), data.tobytes(), b"\n"])


def read_block(data: memoryview, at: int) -> tuple[np.ndarray, np.ndarray, list[str | None], int]:
    """(ids, ids per title, names, place after the block) of the block at `at`."""
    magic, titles, n, ranks, width, size = struct.unpack_from(HEAD, data, at)
    if magic != MAGIC:
        raise ValueError(f"no block at byte {at}")
    at += struct.calcsize(HEAD)
    table = np.frombuffer(data, f"<u{width}", ranks, at).astype(np.uint32)
    at += width * ranks
    lengths = np.frombuffer(data, "<u4", titles, at).astype(np.int64)
    at += 4 * titles
    sizes = np.frombuffer(data, "<u4", titles, at).tolist()
    at += 4 * titles
    names = []
    for n_bytes in sizes:
        names.append(None if n_bytes == NO_NAME else str(data[at: at + n_bytes], "utf-8"))
        at += 0 if n_bytes == NO_NAME else n_bytes
    control = np.frombuffer(data, np.uint8, -(-n // 4), at)
    at += len(control)
    coded = np.frombuffer(data, np.uint8, size, at)
    sizes = _LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(sizes) - sizes
    value = coded[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        if len(more):
            value[more] |= coded[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[value], lengths, names, at + size + 1


def _blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        ids, lengths, names, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            block = write_block(np.concatenate(ids), np.concatenate(lengths), names)
            return pa.RecordBatch.from_arrays([pa.array([block[:-1]], pa.binary())], names=["block"])

        for batch in slices(batches, "title", SLICE_BYTES):
            own, per_title = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            names += [None if x is None else x.encode() for x in batch.column(0).to_pylist()]
            ended = np.full(len(own) + len(per_title), END_ID, np.uint32)
            ended[np.arange(len(own)) + np.repeat(np.arange(len(per_title)), per_title)] = own
            ids.append(ended)
            lengths.append(per_title + 1)
            held += len(ended)
            if held >= BLOCK_IDS:
                yield out()
                ids, lengths, names, held = [], [], [], 0
        if lengths:
            yield out()
        pa.default_memory_pool().release_unused()  # the worker lives on, maybe for tasks of other kinds

    return run


def write_titles(items: DataFrame, folder: str, *, tokenizer: str) -> None:
    """Write the ids of every title of `items` (`item_id`, `title`) below `folder`, in ascending item_id order.

    `tokenizer` is the path of a tokenizers file on every executor. Titles are dealt out by ranges of item_id (and of a
    hash of the title, so that repeated ids can be split) and encoded in that order. The files are written by Spark,
    so a retried task leaves one file, and any file system Spark can write to will do. The line feed that ends a block
    is the writer's row end.
    """
    mark = F.xxhash64("title")
    dealt = items.select("item_id", "title", mark.alias("mark")).repartitionByRange("item_id", "mark")
    ordered = dealt.sortWithinPartitions("item_id", "mark").select(
        F.col("item_id").cast("string").alias("item_id"), "title")
    ordered.mapInArrow(_blocks(tokenizer), "block binary").select(F.col("block").cast("string").alias("value")).write.text(folder)


def _titles_of(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in files:
        for path, content in zip(batch.column(0), batch.column(1)):
            data, at, start = memoryview(content.as_buffer()), 0, 0
            while at < len(data):
                ids, lengths, names, at = read_block(data, at)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py().rsplit("/", 1)[1]] * k), pa.array(names, pa.string()), pa.array(start + ends - lengths),
                     pa.array(lengths), pa.array(sums, pa.int64())], names=["file", "item_id", "begin", "n_tokens", "ids_crc32"])
                start += int(ends[-1])


def read_titles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per title of the files below `folder`: `item_id` (as text), `file`, `start` (ids of all titles before
    it), `n_tokens` (with the end id) and `ids_crc32` (of the ids as little-endian 32-bit numbers), all from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    rows = stage(files.mapInArrow(_titles_of, "file string, item_id string, begin bigint, n_tokens bigint, ids_crc32 bigint"), "read-titles")
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    # one row per file; the number, because names of more than 100,000 files are not in its order
    number = "CAST(regexp_extract(file, 'part-([0-9]+)', 1) AS BIGINT)"
    before = F.expr(f"sum(ids) OVER (ORDER BY {number}, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = sizes.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, "file").select("item_id", "file", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def encode_titles(items: DataFrame, *, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the token ids of all titles as files and return what the files say: see `read_titles`.

    `items` needs `item_id` and `title`; other columns are not read. A NULL title is empty and has the end id only.
    Repeated ids each have their ids in the files, in the order of a hash of the title; NULL ids come first. An empty
    table gives no block and an empty result. `folder` is new; without it one below `spark.checkpoint.dir` is used.
    Blocks rank ids by their own frequencies, so titles are tokenized and moved once and a file can be read alone.
    """
    spark = items.sparkSession
    folder = folder or scratch_dir(spark, "title-ids")
    write_titles(items, folder, tokenizer=tokenizer)
    return read_titles(spark, folder).withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))
