"""Binary segments: addressing, reading, decryption with given keys, container census; text and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediatally.functions import media, text
from mediatally.operators.logs import log_line


def segment_key(task: Column, index: Column) -> Column:
    """`task#00000007`, whose text order is the numeric order."""
    return F.format_string("%s#%08d", task.cast("string"), index.cast("bigint"))


def address_segments(files: DataFrame, path: str = "path") -> DataFrame:
    """task_id and segment_index from the file name of each segment."""
    shape = r"([^/#]+)#(\d+)[^/]*$"
    name = F.replace(F.col(path), F.lit("%23"), F.lit("#"))
    return files.withColumns({
        "task_id": F.regexp_extract(name, shape, 1), "segment_index": F.regexp_extract(name, shape, 2).try_cast("bigint")
    }).filter("segment_index IS NOT NULL")


def scan_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stored segment files of a folder as rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return address_segments(files).select("task_id", "segment_index", "length", "content")


def decrypt_segments(segments: DataFrame, keys: DataFrame, *, by: str = "task_id") -> DataFrame:
    """AES-128-CBC with the key table's `key` and optional `iv_hex`; without an IV the segment's sequence number is used.

    A segment that is no whole number of blocks is tried again on its whole blocks. What cannot be opened
    is labelled `decrypt_failed`. Segments without a key stay as they are.
    """
    df = segments.join(keys.select(by, "key", "iv_hex"), by, "left")
    iv = text.aes_iv(F.col("iv_hex"), F.col("segment_index"))
    opened = lambda body: F.try_aes_decrypt(F.concat(iv, body), F.col("key"), F.lit("CBC"), F.lit("PKCS"))
    whole = F.length("content") - F.length("content") % 16
    retried = F.when((whole > 0) & (whole != F.length("content")), opened(F.substring(F.col("content"), F.lit(1), whole)))
    plain = F.when(F.col("key").isNull(), F.col("content")).otherwise(F.coalesce(opened(F.col("content")), retried))
    status = F.when(F.col("key").isNull(), F.lit("clear")).when(F.col("plain").isNull(), F.lit("decrypt_failed")).otherwise(F.lit("decrypted"))
    return df.withColumn("plain", plain).withColumn("status", status).drop("key", "iv_hex", "content")


def container_census(files: DataFrame) -> DataFrame:
    """Number and bytes of files per container family and brand; reads only the head of each value."""
    brand = media.ftyp_brand(F.col("content"))
    return files.select(brand.alias("b"), F.length("content").cast("bigint").alias("n")).groupBy(
        F.col("b.is_mp4").alias("is_mp4"), F.col("b.major_brand").alias("major_brand"), F.col("b.family").alias("family")
    ).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Log lines as text files."""
    logs.select(log_line().alias("value")).write.mode("errorifexists").text(path)


def read_domain_lines(spark: SparkSession, path: str) -> DataFrame:
    """A domain list, one entry per line."""
    return spark.read.text(path)
