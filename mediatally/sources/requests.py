"""Request logs and hints: schemas, readers, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REQUEST_SCHEMA = (
    "request_id bigint, tab_id bigint, frame_id int, ts_ms bigint, method string, status_code int, kind string, "
    "url string, response_headers array<struct<name:string,value:string>>"
)


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet", *, streaming: bool = False,
                  schema: str = REQUEST_SCHEMA, **options: str) -> DataFrame:
    """A request log as a table or a stream. Both events of one request are rows; the 60 s dedup absorbs the second."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).options(**options).load(path)


def header(headers: Column, name: str) -> Column:
    """Value of the first header with this name, ignoring case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def _flat(df: DataFrame, content_type: Column, content_length: Column, content_range: Column) -> DataFrame:
    size = F.nullif(content_length.cast("string"), F.lit("")).try_cast("double")
    return df.withColumns({
        "mime": F.substring_index(content_type, ";", 1),
        "size": F.when(~F.isnan(size) & (F.abs(size) != float("inf")), size).cast("bigint"),
        "has_range": (F.coalesce(content_range, F.lit("")) != "") | (F.col("status_code") == 206),
    })


def normalize_request(df: DataFrame) -> DataFrame:
    """Mime, size and has_range from the headers, or from the flat columns content_type / content_length."""
    if "response_headers" in df.columns:
        h = F.col("response_headers")
        return _flat(df, header(h, "content-type"), header(h, "content-length"), header(h, "content-range"))
    content_range = F.col("content_range") if "content_range" in df.columns else F.lit(None).cast("string")
    return _flat(df, F.col("content_type"), F.col("content_length"), content_range)
