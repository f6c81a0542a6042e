"""Admission of requests: HTTP filter, domain rules, type / size / extension filters, settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from mediatally.functions import media, urls

# Defaults of the admission and download settings.
DEFAULT_EXTENSIONS = ["mp4", "webm", "flv", "mkv", "ts", "mp3", "m4a", "aac", "mov", "m4s"]


@dataclass(frozen=True)
class Admission:
    """Settings of the admission step."""

    media_type: str = "all"
    min_size_mb: float | None = None
    max_size_mb: float | None = None
    extensions: list[str] = field(default_factory=lambda: list(DEFAULT_EXTENSIONS))
    domain_mode: str = "blacklist"
    domains: list[str] = field(default_factory=list)
    # page hints pass the domain rules and filters like network hints; else they are all taken
    screen_page_hints: bool = False


def admit_http(df: DataFrame) -> DataFrame:
    """plain column predicates, so that they reach the scan."""
    return df.filter(
        (F.col("tab_id") >= 0) & (F.col("status_code") >= 200) & (F.col("status_code") < 400) & (F.col("method") != "OPTIONS")
    )


def tidy_domain(domain: Column) -> Column:
    """Lower case, white space at both ends cut."""
    return F.lower(F.regexp_replace(domain, r"(?U)^\s+|\s+$", ""))


def host_suffixes(host: Column) -> Column:
    """`a.b.c` as [a.b.c, b.c, c]: the names a domain rule may match."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_listed(df: DataFrame, rules: list[str] | DataFrame, host: str = "host") -> DataFrame:
    """`df` with a boolean `listed`: the host or a parent domain of it is a rule.

    A rule list becomes a rule table (column `domain`). Rules are matched against the distinct hosts by an
    equality join on host suffixes, so a busy host costs one row. Wildcard entries match nothing.
    """
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame([(r,) for r in rules], "domain string")
    rules = rules.select(tidy_domain(F.col("domain")).alias("_suffix")).filter((F.col("_suffix") != "") & ~F.col("_suffix").startswith("*.")).distinct()
    hosts = df.select(F.col(host).alias("_host")).filter(F.col("_host").isNotNull()).distinct()
    matched = (
        hosts.withColumn("_suffix", F.explode(host_suffixes(F.col("_host"))))
        .join(rules, "_suffix", "left_semi").select("_host").distinct().withColumn("_hit", F.lit(True))
    )
    joined = df.join(matched, F.col(host) == F.col("_host"), "left")
    return joined.withColumn("listed", F.coalesce("_hit", F.lit(False))).drop("_host", "_hit")


def admit_domain(df: DataFrame, rules: list[str] | DataFrame, mode: str = "blacklist", host: str = "host") -> DataFrame:
    """rows whose host the rules admit. `blacklist` drops listed hosts, `whitelist` keeps only those, `all` keeps every row."""
    if mode == "all":
        return df
    flagged = domain_listed(df, rules, host)
    keep = F.col("listed") if mode == "whitelist" else ~F.col("listed")
    return flagged.filter(keep).drop("listed")


def filter_reason(url: Column, mime: Column, size: Column, cfg: Admission, kind: Column | None = None) -> Column:
    """the filter that rejects a hint, NULL when it is admitted. Manifests and segments always pass; unknown sizes pass."""
    mb = 1024 * 1024
    kind = media.classify_hint(url, mime) if kind is None else kind
    is_audio = media.media_type(url, mime) == "audio"
    ext = F.lower(F.regexp_extract(urls.without_query(url), r"([^.]*)$", 1))
    no_mime = F.coalesce(mime, F.lit("")) == ""
    reason = F.when(~kind.isin("progressive", "blob"), F.lit(None).cast("string"))
    if cfg.media_type in ("video", "audio"):
        reason = reason.when(is_audio if cfg.media_type == "video" else ~is_audio, F.lit("type"))
    if cfg.min_size_mb is not None:
        reason = reason.when(size < cfg.min_size_mb * mb, F.lit("min_size"))
    if cfg.max_size_mb is not None:
        reason = reason.when(size > cfg.max_size_mb * mb, F.lit("max_size"))
    return reason.when(no_mime & (ext != "") & ~ext.isin(cfg.extensions) & (kind == "progressive"), F.lit("extension"))


def apply_filters(df: DataFrame, cfg: Admission) -> DataFrame:
    """`df` with `reject_reason`; keep rows where it is NULL, count the others."""
    known = F.col("hint_kind") if "hint_kind" in df.columns else None
    return df.withColumn("reject_reason", filter_reason(F.col("url"), F.col("mime"), F.col("size"), cfg, known))


def import_domains(lines: DataFrame, line: str = "value") -> DataFrame:
    """Every line as `domain` and `valid`; white space is cut and case folded first."""
    domain = tidy_domain(F.col(line))
    return lines.select(domain.alias("domain")).withColumn("valid", F.col("domain").rlike(r"^[a-z0-9][a-z0-9.\-]*\.[a-z]{2,}$"))


def union_domains(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """The distinct union of a rule list and the valid imported lines."""
    return existing.select("domain").union(imported.filter("valid").select("domain")).distinct()
