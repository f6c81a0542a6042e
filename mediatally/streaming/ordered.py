"""Streams whose rules go by event order: rows wait until the watermark has passed them and are then taken in order.

A rule that looks at the row before cannot run on a micro-batch as it comes: files arrive out of order, and a row that
comes later may belong earlier. So every state key first keeps its rows. A timeout at the earliest one wakes the key
when the watermark has passed it; Spark drops rows at or behind the watermark, so nothing can come before what is then
released, and the rule's result is that of the sorted table, however the rows arrived.

A state key is a bucket of many logical keys, so that one call and one state access serve many of them. Waiting rows
and the rule's own state are stored as Arrow tables. What waits is bounded by the rows within the watermark's delay.
Rows reach a key as Arrow slices (`applyInPandasWithState`), not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState

BUCKETS = 256
HELD = "due bigint, waiting array<binary>, names array<string>, memory array<binary>"  # a key's state


def packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


class InOrder:
    """Base of the ordered rules: subclasses give `decide` and, if the rule has times of its own, `next_time`.

    `order` are the columns to sort by, a time in milliseconds first; `inputs` the columns the rule reads; `output` those it gives.
    `decide(rows, upto, memory)` gets the released rows in order of `order`, the watermark in milliseconds and the
    rule's memory (any picklable frame dictionary, None at first). It returns output rows and the new memory, None to
    forget it. Output comes only from here.
    """

    def __init__(self, order: list[str], inputs: list[str], output: list[str]):
        self.order, self.inputs, self.output = order, inputs, output

    def decide(self, rows: pd.DataFrame, upto: int, memory: dict[str, pd.DataFrame]) -> tuple[list[tuple], dict[str, pd.DataFrame]]:
        raise NotImplementedError

    def next_time(self, memory: dict[str, pd.DataFrame]) -> int | None:
        """When the rule itself has something to say, without another row."""
        return None

    def advance(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One call for a key, with new rows or because it is due: rows are put by as they come, and when the watermark has
        reached the earliest one or the rule's own time, everything up to it is released."""
        upto = state.getCurrentWatermarkMs()
        due, waiting, names, raw = state.get if state.exists else (None, [], [], [])
        came = [pdf[self.inputs] for pdf in batches if len(pdf)]
        if came:
            rows = pd.concat(came, ignore_index=True)
            waiting = [*waiting, packed(rows)]
            first = int(rows[self.order[0]].min())
            due = first if due is None else min(due, first)
        out = []
        if due is not None and due <= upto:
            rows = pd.concat(map(unpacked, waiting), ignore_index=True) if waiting else pd.DataFrame(columns=self.inputs)
            early = rows[self.order[0]] <= upto
            out, memory = self.decide(rows[early].sort_values(self.order, kind="stable"), upto, dict(zip(names, map(unpacked, raw))))
            rest = rows[~early]
            waiting = [packed(rest)] if len(rest) else []
            names, raw = list(memory), [packed(pdf) for pdf in memory.values()]
            times = [int(rest[self.order[0]].min()) if len(rest) else None, self.next_time(memory)]
            due = min((t for t in times if t is not None), default=None)
        if waiting or names:
            state.update((due, waiting, names, raw))
        elif state.exists:
            state.remove()
        if due is not None:
            state.setTimeoutTimestamp(max(due - 1, upto, 1))  # Spark calls when the watermark is beyond it
        if out:
            yield pd.DataFrame(out, columns=self.output).convert_dtypes()


def in_buckets(stream: DataFrame, keys: list[Column], *, buckets: int, shards: int = 1, part: Column | None = None,
               everywhere: Column | None = None) -> DataFrame:
    """`stream` with `bucket` (and `shard` if there are several): rows of equal `keys` and shard share a bucket.

    A key may be split into `shards` by `part`, so that one busy key is spread over many buckets; rows where `everywhere` holds
    concern the whole key and go to all its shards.
    """
    if part is not None:
        own = F.array(F.pmod(F.xxhash64(part), F.lit(shards)).cast("int"))
        at = own if everywhere is None else F.when(everywhere, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)
        stream = stream.withColumn("shard", F.explode(at))
        keys = [*keys, F.col("shard")]
    return stream.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def in_order(stream: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    """The rule over `stream`, which has `bucket` and a watermark."""
    return stream.groupBy("bucket").applyInPandasWithState(processor.advance, schema, HELD, "append", "EventTimeTimeout")
