"""The column functions as SQL functions of a session."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from mediatally.functions import media, text, urls

Function = tuple[str, Callable[..., Column]]

# name: parameters with their types, and the column function behind it
FUNCTIONS: dict[str, Function] = {
    "normalize_url": ("url STRING", urls.normalize_url),
    "dir_of": ("url STRING", urls.dir_of),
    "title_from_url": ("url STRING", urls.title_from_url),
    "host_of": ("url STRING", urls.host_of),
    "ext_from_url": ("url STRING", urls.ext_from_url),
    "resolve_url": ("base STRING, rel STRING", urls.resolve_url),
    "sanitize_url": ("url STRING", urls.sanitize_url),
    "parse_track_url": ("url STRING", urls.parse_track_url),
    "clean_title": ("raw STRING", text.clean_title),
    "hash_key": ("key STRING", text.hash_key),
    "format_bytes": ("n DOUBLE", text.format_bytes),
    "format_duration": ("sec DOUBLE", text.format_duration),
    "parse_iso_duration": ("duration STRING", text.parse_iso_duration),
    "aes_iv": ("iv_hex STRING, sequence BIGINT", text.aes_iv),
    "classify_hint": ("url STRING, mime STRING", media.classify_hint),
    "media_type": ("url STRING, mime STRING", media.media_type),
    "resolution_of": ("resolution STRING", media.resolution_of),
    "quality_label_dash": ("resolution STRING", media.quality_label_dash),
}

# function names that SQL only takes in backquotes, when they are called like any other function
_OPERATORS = ["and", "or", "not", "in", "<=>", "<=", ">=", "!=", "==", "=", "<", ">", "+", "-", "*", "/", "%", "!", "~", "&", "|", "^"]
_CALL = re.compile(r"(?<![\w`'])(" + "|".join(map(re.escape, _OPERATORS)) + r")\(")
_TEXT = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_INFINITE = re.compile(r"(?<![\w'])Infinity\b")


def sql_text(column: Column) -> str:
    """The expression as SQL text."""
    parts = _TEXT.split(column._jc.node().sql())
    return "".join(p if i % 2 else _INFINITE.sub("DOUBLE('Infinity')", _CALL.sub(r"`\1`(", p)) for i, p in enumerate(parts))


def register(spark: SparkSession, prefix: str = "mt_") -> list[str]:
    """2.11: register the column functions as temporary SQL functions `mt_…`; gives their names.

    They are SQL expressions that the optimizer puts in place, so a query in plain SQL has the plan of the column form: no Python,
    filters pushed down.
    """
    names = []
    for name, (parameters, fn) in FUNCTIONS.items():
        given = [p.split() for p in parameters.split(", ")]
        column = fn(*[F.col(p) for p, _ in given])
        typed = spark.range(0).select(*[F.lit(None).cast(t).alias(p) for p, t in given]).select(column.alias("r")).schema["r"].dataType
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {typed.simpleString()} RETURN {sql_text(column)}")
        names.append(prefix + name)
    return names
