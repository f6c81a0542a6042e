"""The corpus pipeline: from given documents to files of token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes every stage's result to the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediatally.llm import encoding, language, mixing, simhash, tiling
from mediatally.session import stage

LEAST_SCORE = 0.2  # share of known n-grams below which …
LEAST_LENGTH = 50  # … a text of this many characters is in no known language


def _as_items(docs: DataFrame) -> DataFrame:
    """Documents as items: their id, text and source by the library's names, all other columns in one struct."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"), F.col("lang"), F.col("source").alias("site"), rest.alias("_doc"))


def _as_documents(items: DataFrame, columns: list[str]) -> DataFrame:
    return items.select(*[F.col("title").alias("text") if c == "text" else F.col(f"_doc.`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language: `und`, or long and hardly any known n-gram. Learns from all given langs."""
    named = language.title_languages(_as_items(docs), F.lit(True))
    foreign = (F.col("score") < LEAST_SCORE) & (F.length("title") >= LEAST_LENGTH)
    return _as_documents(named.filter((F.col("lang_pred") != language.NO_LANGUAGE) & ~foreign), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return _as_documents(simhash.keep_one(_as_items(docs)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark text."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    reserved = benchmark.select(F.col("item_id").alias("reserved_id"), "text")
    return _as_documents(tiling.without_reserved(_as_items(docs), reserved), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _as_documents(mixing.emit_mix(mixing.mix_sites(_as_items(docs))), docs.columns)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files of token ids, and what they say of each document."""
    import public_tokenizers

    read = encoding.encode_titles(_as_items(docs), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return read.select(F.col("item_id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix),
          ("token_binary", token_binary)]
ORACLE_SQL = None  # tokens and fingerprints are beyond SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
