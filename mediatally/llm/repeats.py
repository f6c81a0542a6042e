"""Repeated passages of log messages, found with FM-indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mediatally.llm.words import U64, run_hashes, slices, span_hashes, spread, word_hashes, words_of

WINDOW = 35
ANCHOR = 6  # words of the run that names a window's shard
MOST = 28  # windows in a segment, at most
SHARD_BYTES = 4 << 20  # message text per shard, on average
SAMPLE = 20_000  # messages that frequent runs and windows are looked for in, at most about so many
FREQUENT = 10  # messages of the sample
MARK = U64(1 << 63)  # in anchors of windows all of whose runs are frequent
KNOWN = 2**32 - 1  # place of a segment that is in the index for others' sake only


@dataclass
class Frequent:
    """What a sample shows to be frequent: sorted hashes of ANCHOR words (`anchors`), and sorted `names` of segments (one
    64-bit hash each, and a second one in `checks`). Sorting out frequent segments early changes no result: they stand
    twice in the sample."""

    anchors: np.ndarray
    names: np.ndarray
    checks: np.ndarray

    @staticmethod
    def none() -> Frequent:
        return Frequent(*[np.zeros(0, U64)] * 3)


@dataclass
class Segments:
    """Runs of windows that share an anchor. Segment i of row `row[i]` starts at word `first[i]` and has `windows[i]`
    windows, so `windows[i] + WINDOW - 1` words; `symbols` are one byte a word, `checks` four bytes a window, both
    concatenated; `anchor` is the hash that all its windows have as their least."""

    row: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    symbols: np.ndarray
    checks: np.ndarray


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` consecutive values."""
    held, done = values, 1
    while 2 * done <= span:
        held = np.minimum(held[:-done], held[done:])
        done *= 2
    rest = span - done
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the values in the sorted `known`, -1 for others; a bitmap of low bits spares most the search."""
    out = np.full(len(values), -1)
    if len(known):
        low = np.zeros(1 << 20, bool)
        low[(known & U64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(values & U64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
        out[maybe] = np.where(known[at] == values[maybe], at, -1)
    return out


def segments_of(messages: pa.Array, frequent: np.ndarray = np.zeros(0, U64)) -> Segments:
    """All windows in segments. Runs among `frequent` come after all others. Windows without any other run are segments of
    their own with their own hash as anchor, marked by the highest bit."""
    words = words_of(messages)
    hashes, row = word_hashes(words), words.row
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(U64), none.astype(np.uint8), none.astype(np.uint32))
    runs = run_hashes(hashes, ANCHOR) >> U64(1)
    runs |= np.where(_among(runs, frequent) >= 0, MARK, U64(0))
    anchors = _least(runs, WINDOW - ANCHOR + 1)
    whole = run_hashes(hashes, WINDOW)
    anchors = np.where(anchors >= MARK, whole >> U64(1) | MARK, anchors)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1:])
    anchor, own = anchors[at], row[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (anchor[1:] >= MARK)
    heads = np.flatnonzero(begins)
    sizes = np.diff(np.append(heads, len(at)))
    parts = -(-sizes // MOST)  # long runs are cut
    part = spread(parts)
    head = np.repeat(heads, parts) + part * MOST
    windows = np.minimum(np.repeat(sizes, parts) - part * MOST, MOST)
    first = at[head]
    symbols = (1 + hashes % U64(255)).astype(np.uint8)
    checks = (whole >> U64(32)).astype(np.uint32)
    width = windows + WINDOW - 1
    return Segments(own[head], first - words.first[own[head]], windows, anchor[head],
                    symbols[np.repeat(first, width) + spread(width)], checks[np.repeat(first, windows) + spread(windows)])


def _edges(segments: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first symbol, first check) of every segment."""
    width = segments.windows + WINDOW - 1
    return width, np.cumsum(width) - width, np.cumsum(segments.windows) - segments.windows


def names_of(segments: Segments, own: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the symbols and checks of every segment, or of the segments `own`."""
    width, s_head, c_head = (x[own] for x in _edges(segments))
    return (span_hashes(segments.symbols, s_head, width),
            span_hashes(segments.checks.view(np.uint8), 4 * c_head, 4 * segments.windows[own], 5))


class FmIndex:
    """Counts of byte runs of up to 64 symbols in a text, by backward search.

    The text's suffixes are sorted by their first 64 symbols, which is enough for runs up to that length. The
    symbols before them, in that order, are kept as a wavelet tree in matrix form: eight bit vectors with a count per
    64 bits."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        lanes = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(U64)
        order, rank = self._ranked(lanes)
        for span in (8, 16, 32):
            after = np.zeros(n, np.int64)
            after[:-span] = rank[span:] + 1
            order, rank = self._ranked(rank * np.int64(n + 1) + after)
        before = text[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:256]
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(7, -1, -1):
            bit = (before >> level) & 1
            filled = np.zeros(-(-n // 64) * 64 + 64, np.uint8)
            filled[:n] = bit
            packed = np.packbits(filled, bitorder="little").view(U64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            before = np.concatenate([before[bit == 0], before[bit == 1]])
        self.base = self._down(np.arange(256), np.zeros(256, np.int64))

    @staticmethod
    def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        held = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
        return order, rank

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros)):
            block = at >> 6
            ones = counts[block] + np.bitwise_count(bits[block] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))
            at = np.where((symbol >> (7 - level)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of symbol + run from the ranges [low, high) of the runs."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.start[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol):] + shift


def _run_bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Masks with the bits low..high set; none where low > high."""
    low, high = np.clip(low, 0, 63), np.clip(high, -1, 62)
    one = U64(1)
    mask = (one << (high + 1).astype(U64)) - (one << low.astype(U64))
    return np.where(low <= high, mask, U64(0))


def repeated_windows(symbols: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per segment a mask of the windows whose symbols stand in at least two places of the segments given.

    All segments search at once. A search goes back from the end of a window until its run stands in one place only:
    the run before that step is the longest one ending there, all windows within it are repeated, and no window that
    contains the unique run is. The next search starts where the unique run began, then at the last open window.
    """
    width = windows + WINDOW - 1
    text = np.zeros(int((width + 1).sum()), np.uint8)
    head = np.cumsum(width + 1) - (width + 1)
    text[np.repeat(head, width) + spread(width)] = symbols
    index = FmIndex(text)
    start, size = index.start, np.bincount(text, minlength=256)
    open_ = _run_bits(np.zeros(len(windows), np.int64), windows - 1)
    found = np.zeros(len(windows), U64)
    hint = np.zeros(len(windows), np.int64)
    live = np.flatnonzero(open_)
    while len(live):
        mask = open_[live]
        top = 63 - _leading_zeros(mask)
        lowest = np.bitwise_count((mask & (~mask + U64(1))) - U64(1)).astype(np.int64)
        end = np.where(hint[live] > 0, hint[live], top + WINDOW)
        symbol = text[head[live] + end - 1].astype(np.int64)
        low, high = start[symbol], start[symbol] + size[symbol]
        place = end - 1  # the run is [place, end)
        unique = np.full(len(live), -1, np.int64)
        alone = high - low < 2
        unique[alone] = place[alone]
        go = np.flatnonzero(~alone & (place > lowest))
        while len(go):
            symbol = text[head[live[go]] + place[go] - 1].astype(np.int64)
            l, h = index.extend(symbol, low[go], high[go])
            place[go] -= 1
            alone = h - l < 2
            unique[go[alone]] = place[go[alone]]
            low[go], high[go] = l, h
            go = go[~alone & (place[go] > lowest[go])]
        ended = unique >= 0
        got = _run_bits(np.where(ended, unique + 1, place), end - WINDOW)
        lost = np.where(ended, _run_bits(np.maximum(end - WINDOW, 0), unique), U64(0))
        found[live] |= got & mask
        open_[live] = mask & ~got & ~lost
        hint[live] = np.where(ended & (hint[live] == 0) & (unique + 1 < end), unique + 1, 0)
        live = live[open_[live] != 0]
    return found


def _leading_zeros(mask: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        mask = mask | (mask >> U64(s))
    return 64 - np.bitwise_count(mask).astype(np.int64)


def confirmed(segments: Segments) -> np.ndarray:
    """Per segment of one shard a mask of its repeated windows.

    Segments whose anchor no other one has are left out if their windows differ, and segments that are equal in all symbols and checks are
    searched once. What the index finds is confirmed by the windows' checks.
    """
    k = len(segments.windows)
    out = np.zeros(k, U64)
    _, back, times = np.unique(segments.anchor, return_inverse=True, return_counts=True)
    width, s_head, c_head = _edges(segments)
    shared = times[back] > 1
    # a segment whose anchor is its own can hold equal windows itself
    own = np.sort((np.repeat(np.arange(k), segments.windows) << 32 | segments.checks)[np.repeat(~shared, segments.windows)])
    shared[own[1:][own[1:] == own[:-1]] >> 32] = True
    keep = np.flatnonzero(shared)
    if not len(keep):
        return out
    names = np.stack(names_of(segments), 1)[keep]
    _, one, back, times = np.unique(names, axis=0, return_index=True, return_inverse=True, return_counts=True)
    back = back.reshape(-1)
    first = keep[one]
    wide, many = width[first], segments.windows[first]
    symbols = segments.symbols[np.repeat(s_head[first], wide) + spread(wide)]
    found = repeated_windows(symbols, many)
    found[times > 1] = _run_bits(np.zeros((times > 1).sum(), np.int64), many[times > 1] - 1)
    # the check: windows are equal if symbols and 32 more bits are
    of, at = np.repeat(np.arange(len(first)), many), spread(many)
    hit = ((found[of] >> at.astype(U64)) & U64(1)).astype(bool)
    of, at = of[hit], at[hit]
    where = (np.cumsum(wide) - wide)[of] + at
    content = run_hashes(symbols.astype(U64) + U64(1), WINDOW)[where] ^ (segments.checks[c_head[first][of] + at].astype(U64) << U64(32))
    _, same = np.unique(content, return_inverse=True)
    enough = np.bincount(same, weights=np.minimum(times, 2)[of])[same] >= 2
    exact = np.zeros(len(first), U64)
    np.bitwise_or.at(exact, of[enough], U64(1) << at[enough].astype(U64))
    out[keep] = exact[back]
    return out


def _packed(key: np.ndarray, first: np.ndarray, s: Segments, own: np.ndarray) -> bytes:
    """The segments `own` as one value."""
    width, s_head, c_head = _edges(s)
    wide, many = width[own], s.windows[own]
    return b"".join([
        key.astype("<i8").tobytes(), s.anchor[own].astype("<u8").tobytes(), first.astype("<u4").tobytes(), many.astype("u1").tobytes(),
        s.symbols[np.repeat(s_head[own], wide) + spread(wide)].tobytes(), s.checks[np.repeat(c_head[own], many) + spread(many)].astype("<u4").tobytes()])


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.append(np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]), len(order)) if len(order) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(shard[order[a]]), order[a:b]


def known_segments(s: Segments, frequent: Frequent) -> np.ndarray:
    """Which segments are among the frequent ones; they have marked anchors."""
    known = np.zeros(len(s.row), bool)
    marked = np.flatnonzero(s.anchor >= MARK)
    if len(marked) and len(frequent.names):
        names, checks = names_of(s, marked)
        at = _among(names, frequent.names)
        known[marked] = (at >= 0) & (checks == frequent.checks[at])
    return known


def _emit(shards: int, given):
    """Segments by shard; the spans of frequent segments by shard numbers from `shards` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = given.value
        for batch in slices(batches, "msg"):
            key = batch.column(0).to_numpy()
            s = segments_of(batch.column(1), frequent.anchors)
            if not len(s.row):
                continue
            known = known_segments(s, frequent)
            rows = []
            if known.any():
                own = np.flatnonzero(known)
                row, begin, end = s.row[own], s.first[own], s.first[own] + s.windows[own] + WINDOW - 1
                heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (begin[1:] > end[:-1])])
                ends = np.append(heads[1:], len(own)) - 1
                spans = np.stack([key[row[heads]], begin[heads], end[ends]], 1).astype("<i8")
                rows.append((shards + int(key[0]) % shards, len(heads), spans.tobytes()))
            rest = np.flatnonzero(~known)
            for shard, own in _groups((s.anchor[rest] % U64(shards)).astype(np.int64)):
                own = rest[own]
                rows.append((shard, len(own), _packed(key[s.row[own]], s.first[own], s, own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                names=["shard", "segments", "packed"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of ANCHOR words of the sample, and in how many messages they stand."""
    for batch in slices(batches, "msg"):
        words = words_of(batch.column(0))
        hashes, row = word_hashes(words), words.row
        inside = np.flatnonzero(row[: max(len(row) - ANCHOR + 1, 0)] == row[ANCHOR - 1:])
        runs, row = (run_hashes(hashes, ANCHOR) >> U64(1))[inside], row[inside]
        order = np.lexsort((row, runs))
        runs, row = runs[order], row[order]
        once = np.ones(len(runs), bool)
        once[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
        runs, times = np.unique(runs[once], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(times, pa.int64())], names=["run", "n"])


def _seen(given):
    """Segments of the sample with marked anchors, once per message. Others have a run that is not frequent, so are not
    frequent themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "msg"):
            s = segments_of(batch.column(0), given.value)
            marked = np.flatnonzero(s.anchor >= MARK)
            names, checks = names_of(s, marked)
            _, one = np.unique(np.stack([s.row[marked].astype(U64), names, checks], 1), axis=0, return_index=True)
            packed = [_packed(np.zeros(1), np.array([KNOWN]), s, marked[i: i + 1]) for i in one]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[one].view(np.int64)), pa.array(checks[one].view(np.int64)), pa.array(packed, pa.binary()),
                 pa.array(s.anchor[marked[one]].view(np.int64))], names=["name", "check", "packed", "anchor"])

    return run


def frequent_parts(keyed: DataFrame, shards: int) -> tuple[Frequent, list[tuple[int, int, bytes]]]:
    """What is frequent in a sample of about SAMPLE messages, and the frequent segments as rows for their shards.

    All runs of ANCHOR words are counted, not only those that are anchors now: with the frequent ones out of the way no
    other frequent one can take their place. The sample only decides which way a segment takes, never a result. Its size
    bounds what reaches the driver.
    """
    spark = keyed.sparkSession
    every = max(1, -(-keyed.count() // SAMPLE))
    sample = keyed.filter(F.pmod("key", F.lit(every)) == 0).select("msg")
    often = sample.mapInArrow(_runs, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    anchors = np.sort(often.select("run").toPandas()["run"].to_numpy(dtype=np.int64).view(U64))
    if not len(anchors):
        return Frequent.none(), []
    schema = "name bigint, check bigint, packed binary, anchor bigint"
    parts = sample.mapInArrow(_seen(spark.sparkContext.broadcast(anchors)), schema).groupBy("name", "check").agg(
        F.count(F.lit(1)).alias("n"), F.min("packed").alias("packed"), F.min("anchor").alias("anchor")).filter(F.col("n") >= FREQUENT).toPandas()
    names, checks = (parts[c].to_numpy(dtype=np.int64).view(U64) for c in ("name", "check"))
    order = np.argsort(names)
    shard = (parts["anchor"].to_numpy(dtype=np.int64).view(U64) % U64(shards)).astype(np.int64)
    # twice, because they are known to stand in more than one place
    rows = [(int(n), 1, bytes(p)) for n, p in zip(shard, parts["packed"]) for _ in range(2)]
    return Frequent(anchors, names[order], checks[order]), rows


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, Segments]:
    parts = []
    for n, data in zip(rows["segments"], rows["packed"]):
        at = 0
        own = []
        for kind, size in (("<i8", 8), ("<u8", 8), ("<u4", 4), ("u1", 1)):
            own.append(np.frombuffer(data, kind, n, at))
            at += size * n
        symbols = int(own[3].sum(dtype=np.int64)) + n * (WINDOW - 1)
        own.append(np.frombuffer(data, np.uint8, symbols, at))
        own.append(np.frombuffer(data, "<u4", int(own[3].sum(dtype=np.int64)), at + symbols))
        parts.append(own)
    key, anchor, first, windows, symbols, checks = (np.concatenate(p) for p in zip(*parts))
    return key, Segments(np.zeros(0, np.int64), first.astype(np.int64), windows.astype(np.int64), anchor, symbols, checks)


def _search(rows: pd.DataFrame, shards: int) -> pd.DataFrame:
    if rows["shard"].iloc[0] >= shards:
        spans = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 3) for p in rows["packed"]])
        return pd.DataFrame(spans.astype(np.int64), columns=["key", "begin", "end"])
    key, segments = _unpacked(rows)
    mask = confirmed(segments)
    hit = np.flatnonzero((mask != 0) & (segments.first != KNOWN))
    bits = ((mask[hit][:, None] >> np.arange(MOST + 1, dtype=U64)) & U64(1)).astype(np.int8)
    edge = np.diff(bits, axis=1, prepend=0)
    of, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # as many as begins, in the same order: bit MOST is never set
    first = segments.first[hit[of]]
    return pd.DataFrame({"key": key[hit[of]], "begin": first + begin, "end": first + end - 1 + WINDOW})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw = text.as_py()
            words = raw.encode("utf-8", "surrogatepass").split() if raw else []
            if spans.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, spans.values.field(0).to_numpy(), 1)
                np.add.at(gone, spans.values.field(1).to_numpy(), -1)
                kept = [w for w, g in zip(words, np.cumsum(gone)) if g == 0]
            else:
                kept = words
            joined = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), joined, hashlib.sha256(joined).hexdigest()))
        n, removed, kept, sha = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
            names=["log_id", "n_words", "n_removed", "kept_msg", "kept_sha256"])


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """`key` and `spans` (begin and end words, in no order) of all passages to remove, from `key` and `msg`."""
    size = keyed.agg(F.sum(F.octet_length("msg"))).first()[0] or 0
    shards = int(max(16, size // SHARD_BYTES + 1))
    frequent, known = frequent_parts(keyed, shards)
    schema = "shard bigint, segments bigint, packed binary"
    packed = keyed.select("key", "msg").mapInArrow(_emit(shards, keyed.sparkSession.sparkContext.broadcast(frequent)), schema)
    if known:
        packed = packed.unionByName(keyed.sparkSession.createDataFrame(known, schema))
    spans = packed.groupBy("shard").applyInPandas(lambda rows: _search(rows, shards), "key bigint, begin bigint, end bigint")
    return spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def drop_repeated_passages(logs: DataFrame) -> DataFrame:
    """Log messages without the words of passages that stand elsewhere, too.

    `logs` needs `log_id` and `msg`; other columns are not read. Words are runs of characters other than blank and
    tab to carriage return. A window is 35 consecutive words of one message; every word goes that lies in a window
    whose word sequence also starts anywhere else, in the same message too. Windows are judged on the messages as
    given. Returns one row per input row: `log_id`, `n_words`, `n_removed`, `kept_msg` (kept words joined by one blank)
    and `kept_sha256`. NULL messages have no words; messages under 35 words stay. Repeated rows count as repeated
    passages. An empty table gives an empty one.

    Equal windows have equal least anchors (hashes of six consecutive words), so windows go to the shard of their
    anchor, consecutive ones together in a segment. A shard builds one FM-index over its segments' one-byte word
    symbols and streams the segments through it; windows found twice are confirmed by 32 more bits of a window hash.
    The number of shards follows the size of the messages, so a shard's index stays bounded. Runs of six words that are
    frequent in a sample are no anchors; windows that hold no other run are dealt out one by one, by a hash of all their
    words, and those of them that are frequent in the sample, so known to stand in several places, stay out of the
    shards but for one copy that the others are compared with: no shard gets all
    copies of a passage that a third of the messages share. Messages move once, to meet their spans.
    """
    rows = logs.select("log_id", "msg", F.xxhash64("log_id", "msg").alias("key"))
    spans = repeated_spans(rows).withColumnRenamed("key", "_key")
    met = rows.join(spans, F.col("key") == F.col("_key"), "left").select("log_id", "msg", "spans")
    kind = logs.schema["log_id"].dataType.simpleString()
    return met.mapInArrow(_kept, f"log_id {kind}, n_words bigint, n_removed bigint, kept_msg string, kept_sha256 string")
