"""Run logs and local metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediatally.functions import text, urls

# Fixed value: log levels, least severe first.
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]


def filter_logs(logs: DataFrame, level: str | None = None, keyword: str | None = None) -> DataFrame:
    """entries of at least a level (ALL or None for every level) whose message or detail holds a keyword."""
    out = logs
    if level and level != "ALL":
        out = out.filter(F.col("level").isin(LEVELS[LEVELS.index(level):]))
    if keyword:
        out = out.filter(F.concat("msg", F.coalesce("detail", F.lit(""))).contains(keyword))
    return out


def latest_logs(logs: DataFrame, n: int = 1000) -> DataFrame:
    """The newest entries."""
    return logs.orderBy(F.desc("ts_ms"), F.desc("log_id")).limit(n)


def log_line() -> Column:
    """`hh:mm:ss [LEVEL] module: msg (detail)`; a detail that is a URL is masked first."""
    detail = F.when(urls.is_web_url(F.col("detail")), urls.sanitize_url(F.col("detail"))).otherwise(F.col("detail"))
    shown = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(text.format_clock(F.col("ts_ms")), F.lit(" ["), F.col("level"), F.lit("] "), F.col("module"),
                    F.lit(": "), F.col("msg"), shown)


def local_metrics(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Tasks, finished, failed and success rate over `by`."""
    done, failed = F.count_if(F.col("stage") == "done"), F.count_if(F.col("stage") == "failed")
    return tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"), done.alias("done"), failed.alias("failed"),
        F.round(F.try_divide(done, done + failed), 6).alias("success_rate"))


def detection_counts(hints: DataFrame) -> DataFrame:
    """Detected hints by source, media type and protocol."""
    return hints.groupBy("source", "media_type", "protocol").agg(F.count(F.lit(1)).alias("hints"))


def filter_hits(rejected: DataFrame) -> DataFrame:
    """Rejected hints by filter."""
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("hits"))
