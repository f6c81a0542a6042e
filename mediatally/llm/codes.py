"""Compressing vectors to short codes: a codebook per part of the vector, fitted by Lloyd's rounds with resident members.

A part of a vector is a member of the codebook entry nearest to it. Members lie in blocks: the members of one codebook
entry at one part position that came from the same run of input vectors, their values packed into one binary. Blocks
are dealt out by (position, entry, salt). In a round the owner of some blocks sums up its resident members, the sums
give the new entries, every owner compares its members with them, and only members whose entry changes are packed
into new blocks and move in the next shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mediatally.session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26  # components are held within this, so that sums of squares are exact
RUN = 1 << 14  # vectors of one run
STEP = 1 << 13  # members compared with the entries at once

BLOCK = "run bigint, position bigint, entry bigint, salt bigint, rows binary, members binary, errors binary, moved boolean"
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Integer components: floor(256 x), within ±2^26."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int32)


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) per member, exactly; ties go to the lower index."""
    n, width = members.shape
    index, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if width == 0:
        return index, error
    largest = max(int(np.abs(members).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = width * (2 * largest) ** 2
    # whole numbers below 2^24 and 2^53 are exact in these types
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    e = entries.astype(kind)
    squares = (e * e).sum(axis=1)
    for at in range(0, n, STEP):
        m = members[at: at + STEP].astype(kind)
        gap = squares - 2 * (m @ e.T)
        best = gap.argmin(axis=1)
        index[at: at + STEP] = best
        error[at: at + STEP] = gap[np.arange(len(m)), best].astype(np.int64) + (m * m).sum(axis=1).astype(np.int64)
    return index, error


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of `vectors` whose embedding is there and has finite components only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col("embedding").isNotNull() & fine)


def in_order() -> list:
    """Rows by id, then by vector, NULL ids last."""
    return [F.col("vec_id").isNull(), F.col("vec_id"), F.col("embedding")]


def as_long_as_the_first(kept: DataFrame) -> DataFrame:
    """The rows of `kept` whose vectors are as long as the first row's."""
    size = F.size("embedding")
    first = kept.select(F.min_by(size, F.struct(*in_order())).alias("n")).first()["n"]
    return kept.filter(size == F.lit(first if first is not None else 0))


def first_entries(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The starting codebooks, an array (part, entry, place): the parts of the `entries` rows with the smallest ids.

    At most `entries` rows reach the driver, chosen by Spark. None if there is no row or the vectors, of one length,
    cannot be cut into equal parts.
    """
    rows = kept.select("vec_id", "embedding").orderBy(*in_order()).limit(entries).collect()
    if not rows or len(rows[0].embedding) % parts:
        return None
    chosen = scaled(np.array([r.embedding for r in rows], dtype=np.float64))
    return chosen.reshape(len(chosen), parts, chosen.shape[1] // parts).transpose(1, 0, 2).astype(np.int64)


def _blocks(run: int, salt: int, position: int, rows: np.ndarray, members: np.ndarray, entry: np.ndarray, errors: np.ndarray,
            moved: bool) -> Iterator[tuple]:
    """Rows of the block table for members of one run and position, one per entry."""
    order = np.argsort(entry, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(entry[order]) != 0, True]) + 1 if len(order) else []
    start = 0
    for end in ends:
        at = order[start:end]
        start = end
        values = members[at]
        width = np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int32
        yield (run, position, int(entry[at[0]]), salt, rows[at].astype("<u2").tobytes(), values.astype(width).tobytes(),
               errors[at].astype("<i8").tobytes(), moved)


def _frame(blocks: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()] * 3 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), types)], names=BLOCK_NAMES)


def _values(rows: bytes, members: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the run, members) of a block; the bytes per component follow from the sizes."""
    at = np.frombuffer(rows, "<u2")
    size = len(members) // max(len(at) * width, 1)
    return at, np.frombuffer(members, np.int16 if size == 2 else np.int32).reshape(len(at), width)


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[int], np.ndarray, list[np.ndarray], np.ndarray]]:
    """(position, its blocks in the batch, sizes of the blocks, rows per block, all members), so that numpy works on many blocks at once."""
    position = batch.column(1).to_numpy()
    rows, members = batch.column(4), batch.column(5)
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p).tolist()
        parts = [_values(rows[i].as_py(), members[i].as_py(), width) for i in at]
        yield p, at, np.array([len(r) for r, _ in parts]), [r for r, _ in parts], np.concatenate([m for _, m in parts])


def _cut(books: np.ndarray, id_type: pa.DataType, label_type: pa.DataType, salts: int):
    """Runs of vectors as one row of ids and labels each, and blocks of members with their first entries."""
    parts, _, width = books.shape
    heads = ["ids", "labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                piece = batch.slice(at, RUN)
                name = (task << 32) + made
                made += 1
                flat = pc.list_flatten(piece.column(1)).to_numpy(zero_copy_only=False)
                members = scaled(flat).reshape(piece.num_rows, parts, width)
                rows, out = np.arange(piece.num_rows), []
                for p in range(parts):
                    own = np.ascontiguousarray(members[:, p])
                    out += _blocks(name, name % salts, p, rows, own, *nearest(own, books[p]), True)
                ids = pa.array([piece.column(0).to_pylist()], pa.list_(id_type))
                labels = pa.array([piece.column(2).to_pylist()], pa.list_(label_type))
                place = [pa.array([x]) for x in (name, -1, 0, name % salts)]  # dealt out like members
                blank = [pa.nulls(1, t) for t in [pa.binary()] * 3 + [pa.bool_()]]
                yield pa.RecordBatch.from_arrays([*place, *blank, ids, labels], names=BLOCK_NAMES + heads)
                frame = _frame(out)
                yield pa.RecordBatch.from_arrays(
                    [*frame.columns, pa.nulls(len(out), pa.list_(id_type)), pa.nulls(len(out), pa.list_(label_type))], names=BLOCK_NAMES + heads)

    return run


def _sums(width: int):
    """Per task: members and component sums of each entry it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            entry = batch.column(2).to_numpy()
            for p, at, sizes, _, members in _by_position(batch, width):
                ends = np.cumsum(sizes)
                sums = np.add.reduceat(np.c_[members.astype(np.int64), np.ones(len(members), np.int64)], ends - sizes)
                for e, s in zip(entry[at].tolist(), sums):
                    held[p, e] = held[p, e] + s if (p, e) in held else s
        if held:
            keys = np.repeat(np.array(list(held)), width + 1, axis=0)
            values = np.concatenate(list(held.values()))
            place = np.tile(np.arange(width + 1), len(held))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[:, 0], keys[:, 1], place, values)], names=["position", "entry", "place", "total"])

    return run


def updated(books: np.ndarray, resident: DataFrame) -> np.ndarray:
    """New entries: per component the floored mean of the resident members; entries without members stay.

    Every task adds up its residents first. One number per part, entry and place reaches the driver.
    """
    width = books.shape[2]
    summed = resident.mapInArrow(_sums(width), "position bigint, entry bigint, place bigint, total bigint")
    table = summed.groupBy("position", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((books.shape[0], books.shape[1], width + 1), np.int64)
    position, entry, place, total = [table.column(i).to_numpy() for i in range(4)]
    sums[position, entry, place] = total
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)


def _reassign(books: np.ndarray):
    """Blocks as they are where all members stay, cut into those who stay and those who leave elsewhere."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, entry, salt = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out: list[tuple] = []
            for p, at, sizes, rows, members in _by_position(batch, width):
                index, error = nearest(members, books[p])
                start = 0
                for i, n, own in zip(at, sizes.tolist(), rows):
                    new, e, m = index[start: start + n], error[start: start + n], members[start: start + n]
                    start += n
                    stays = new == entry[i]
                    for flag in (False, True):
                        chosen = np.flatnonzero(stays != flag)
                        out += _blocks(names[i], salt[i], p, own[chosen], m[chosen], new[chosen], e[chosen], flag)
            if out:
                yield _frame(out)

    return run


def migrated(resident: DataFrame, books: np.ndarray, partitions: int) -> DataFrame:
    """Residents after a comparison with `books`: members that change their entry are dealt to its owners, the others stay."""
    compared = stage(resident.mapInArrow(_reassign(books), BLOCK), "compared-members")
    leaving = compared.filter("moved").repartition(partitions, "position", "entry", "salt")
    return compared.filter("NOT moved").unionByName(stage(leaving, "moved-members"))


def _codes(parts: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        is_head = pc.is_valid(group["ids"])
        head, blocks = group.filter(is_head), group.filter(pc.invert(is_head))
        ids, labels = head["ids"].combine_chunks().flatten(), head["labels"].combine_chunks().flatten()
        code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
        for p, e, rows, errors in zip(*(blocks[c].to_pylist() for c in ("position", "entry", "rows", "errors"))):
            at = np.frombuffer(rows, "<u2")
            code[at, p] = e
            error[at] += np.frombuffer(errors, "<i8")
        return pa.table({"vec_id": ids, "label": labels, "code": pa.array([c.tobytes().hex() for c in code], pa.string()), "error": pa.array(error)})

    return run


def spelled(books: np.ndarray) -> str:
    """All entries' components by part, entry and place, as decimals joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def compress_vectors(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors: each of `parts` equal parts by the index of its nearest codebook entry.

    A general operator: the library's own records hold no vectors. `vectors` needs `vec_id`, `embedding` (array of
    float or double) and `label`; other columns are not read, whatever their names. Components become floor(256 x).
    The codebooks start from the rows with the smallest ids, `rounds` times each entry becomes the floored mean of
    its members (an entry without members stays), and parts are assigned a last time. Returns one row per kept row:
    `vec_id`, `code` (two hex digits per part), `error` (squared distances summed over parts), `label_error` (error summed
    over equal labels; NULL is a label) and `codebooks_sha256`.

    Rows whose embedding is NULL or holds a NULL or non-finite component are dropped, and so are those not as long as
    the first row's vector; if that cannot be cut into `parts` equal parts, all are. Fewer rows than `entries` give
    fewer entries. Repeated ids each get a row; among the first rows they count one by one, by vector, NULL ids last.
    Empty vectors have parts without components and error 0. Components beyond ±2^26 after scaling are held there. An
    empty table gives an empty one. Results are integers and do not depend on the partitioning.

    No pairs and no groups of unbounded size: a hot entry's members lie in blocks of at most 16,384, dealt out by
    salts as many as there are shuffle partitions. Only the codebooks (one number per part, entry and place) reach the
    driver and all executors. Every round ends in a written table.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: an index has two hex digits")
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    kept = as_long_as_the_first(usable(rows))
    id_type, label_type = vectors.schema["vec_id"].dataType, vectors.schema["label"].dataType
    schema = f"vec_id {id_type.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    books = first_entries(kept, parts=parts, entries=entries)
    if books is None:
        return spark.createDataFrame([], schema)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = kept.mapInArrow(
        _cut(books, to_arrow_type(id_type), to_arrow_type(label_type), partitions),
        f"{BLOCK}, ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>")
    # runs are dealt out with their members; what a task wrote is what all later steps read
    cut = stage(cut.repartition(partitions, "position", "entry", "salt"), "vector-members")
    heads, resident = cut.filter("ids IS NOT NULL"), cut.filter("ids IS NULL").select(*BLOCK_NAMES)
    for done in range(rounds):
        books = updated(books, resident)
        if done < rounds - 1:
            resident = migrated(resident, books, partitions)
    compared = resident.mapInArrow(_reassign(books), BLOCK).select("run", "position", "entry", "rows", "errors")
    ids = heads.select("run", "ids", "labels")
    grouped = compared.unionByName(ids, allowMissingColumns=True).groupBy("run").applyInArrow(
        _codes(parts, books.shape[2]), f"vec_id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error bigint")
    coded = stage(grouped, "vector-codes")
    labels = stage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    digest = sha256(spelled(books).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
