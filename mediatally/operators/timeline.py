"""Fragment timelines and sample tables: order checks, repair, run lengths, chunks, offsets, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.operators.scan import Busy, Running, every, numbered, numbered_runs, running

SEQ_WIDTH = 4096
BYTE_WIDTH = 64 * 1024 * 1024
TRACK = ["file_id", "track_id"]
# Stream type numbers per codec, best match first.
VIDEO_STREAMS = [("h264", [0x1B]), ("hevc", [0x24, 0x25]), ("mpeg2", [0x02])]
AUDIO_STREAMS = [("aac", [0x0F, 0x11]), ("ac3", [0x81]), ("mp3", [0x03])]
VIDEO_NAMES = {"h264": "H.264", "hevc": "HEVC (H.265)", "mpeg2": "MPEG-2"}
AUDIO_NAMES = {"aac": "AAC", "ac3": "AC3", "mp3": "MP3"}


def _with_top(fragments: DataFrame, exclusive: bool) -> DataFrame:
    return running(fragments, keys=TRACK, order=["seq"], bucket=every("seq", SEQ_WIDTH), busy=Busy.of(fragments, TRACK),
                   top=Running("max", F.col("decode_time"), exclusive=exclusive))


def validate_timeline(fragments: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per file whether decode times never go back within a track, with the first place where one does.

    `expected` (file_id, expected) adds the check that at least nine tenths of the fragments are there.
    NULL decode times are skipped.
    """
    back = F.col("decode_time") < F.col("top")
    per_file = _with_top(fragments, exclusive=True).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("fragment_count"), F.count_if(back).alias("regressions"),
        F.min_by(F.struct("seq", "track_id"), F.when(back, F.struct("seq", "track_id"))).alias("_first"))
    if expected is not None:
        per_file = per_file.join(expected, "file_id", "left")
    else:
        per_file = per_file.withColumn("expected", F.lit(0).cast("bigint"))
    few = (F.col("expected") > 0) & (F.col("fragment_count") < F.col("expected") * 0.9)
    reason = (
        F.when(few, F.concat(F.lit("fragment_count_"), F.col("fragment_count").cast("string"), F.lit("_of_"), F.col("expected").cast("string")))
        .when(F.col("_first").isNotNull(), F.concat(F.lit("tfdt_regression_track"), F.col("_first.track_id").cast("string"))))
    return per_file.select("file_id", "fragment_count", "regressions", F.col("_first.seq").alias("first_bad_seq"),
                           reason.isNull().alias("ok"), reason.alias("reason"))


def repair_timeline(fragments: DataFrame) -> DataFrame:
    """Decode times below the running maximum of their track are lifted to it."""
    df = _with_top(fragments, exclusive=False)
    repaired = F.coalesce(F.col("decode_time") < F.col("top"), F.lit(False))
    fixed = F.when(F.col("decode_time").isNotNull(), F.col("top"))
    return df.withColumns({"repaired": repaired, "fixed_time": fixed}).drop("top")


def run_length(samples: DataFrame, value: str, *, keys: list[str] | None = None, order: str = "seq", width: int = SEQ_WIDTH,
               busy: Busy | None = None) -> DataFrame:
    """Runs of equal values in order: keys, run_no, first position, value and length. `busy`: see `busy_files`."""
    keys = keys or TRACK
    busy = busy or Busy.of(samples, keys)
    runs = numbered_runs(samples.select(*keys, order, value), keys=keys, order=[order], bucket=every(order, width),
                         value=F.col(value), link=F.col(value), name="run_no", busy=busy)
    return runs.groupBy(*keys, "run_no").agg(
        F.min(order).alias("first_pos"), F.min(value).alias("run_value"), F.count(F.lit(1)).alias("run_length"))


def busy_files(samples: DataFrame) -> Busy:
    """Files whose samples are too many for one task, counted once for operators that follow each other: as `busy` of
    `assign_offsets`, `contiguous_chunks` and `run_length`. Without it each of them counts its own groups."""
    return Busy.of(samples, ["file_id"])


def assign_offsets(samples: DataFrame, *, busy: Busy | None = None) -> DataFrame:
    """New byte offset of every sample when a file's samples are laid out in source order, tracks interleaved."""
    return running(samples, keys=["file_id"], order=["src_offset"], bucket=every("src_offset", BYTE_WIDTH), busy=busy or busy_files(samples),
                   new_offset=Running("sum", F.col("sample_size"), exclusive=True))


def contiguous_chunks(placed: DataFrame, *, busy: Busy | None = None) -> DataFrame:
    """Chunks of samples that follow each other without a gap in the new layout, per track."""
    chunks = numbered_runs(placed, keys=TRACK, order=["seq"], bucket=every("seq", SEQ_WIDTH), value=F.col("new_offset"),
                           link=F.col("new_offset") + F.col("sample_size"), name="chunk_no", busy=busy or Busy.of(placed, TRACK))
    return chunks.groupBy(*TRACK, "chunk_no").agg(
        F.min("new_offset").alias("chunk_offset"), F.count(F.lit(1)).alias("sample_count"), F.sum("sample_size").alias("chunk_bytes"))


def sync_index(samples: DataFrame) -> DataFrame:
    """1-based numbers of the sync samples of a track; none when all or no samples are sync."""
    ranked = numbered(samples, keys=TRACK, order=["seq"], bucket=every("seq", SEQ_WIDTH), name="sample_no", busy=Busy.of(samples, TRACK))
    mixed = samples.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_sync").alias("_s")).filter("_s > 0 AND _s < _n")
    return ranked.filter("is_sync").join(mixed.select(*TRACK), TRACK, "left_semi").select(*TRACK, "seq", "sample_no")


def duration_totals(samples: DataFrame) -> DataFrame:
    """Sample count, total duration and payload size per track."""
    return samples.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("sample_duration").alias("total_duration"), F.sum("sample_size").alias("total_bytes"))


def codec_census(streams: DataFrame, *, by: str = "segment_id") -> DataFrame:
    """A10: best video and audio codec among the stream types of a segment, with a display label."""
    table = VIDEO_STREAMS + AUDIO_STREAMS
    flags = [F.max(F.col("stream_type").isin(numbers)).alias(f"_{name}") for name, numbers in table]

    def pick(choices):
        out = None
        for name, _ in choices:
            out = F.when(F.col(f"_{name}"), F.lit(name)) if out is None else out.when(F.col(f"_{name}"), F.lit(name))
        return out.otherwise(F.lit("unknown"))

    def shown(column: str, names: dict[str, str]):
        out = None
        for code, name in names.items():
            out = F.when(F.col(column) == code, F.lit(name)) if out is None else out.when(F.col(column) == code, F.lit(name))
        return out.otherwise(F.lit("unknown"))

    df = streams.groupBy(by).agg(*flags).select(by, pick(VIDEO_STREAMS).alias("video"), pick(AUDIO_STREAMS).alias("audio"))
    return df.withColumn("label", F.concat(shown("video", VIDEO_NAMES), F.lit(" + "), shown("audio", AUDIO_NAMES)))
