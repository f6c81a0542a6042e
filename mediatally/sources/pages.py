"""Media elements of crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediatally.functions import media, urls

_TAG = r"""(?i)</?(?:video|audio|source)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_NOT_MARKUP = r"(?is)<!--.*?-->|<(script|style|textarea|title|noscript)\b[^>]*>.*?</\1\s*>"
_ATTR = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""


def _attr(tag: Column, name: str) -> Column:
    """First attribute with this name; NULL when absent."""
    names = F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(1))
    values = F.transform(
        F.arrays_zip(*[F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(g)).alias(f"g{g}") for g in (2, 3, 4)]),
        lambda v: F.concat(v["g2"], v["g3"], v["g4"]))
    at = F.array_position(F.transform(names, lambda n: F.lower(n)), name).cast("int")
    raw = F.when(at > 0, F.get(values, at - 1))
    return _unescaped(raw)


def _unescaped(raw: Column) -> Column:
    """Numeric character references and the five named ones of XML as characters."""
    def char_of(ref: Column) -> Column:
        code = F.when(F.lower(ref).startswith("&#x"), F.conv(F.regexp_extract(ref, r"([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(
            F.regexp_extract(ref, r"(\d+)", 1)).try_cast("bigint")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(raw, F.lit(r"&#(?:[xX][0-9A-Fa-f]+|\d+);"), F.lit(0)))
    raw = F.when(raw.contains("&#"), F.aggregate(refs, raw, lambda acc, ref: F.replace(acc, ref, char_of(ref)))).otherwise(raw)
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return raw


def _elements_by_pattern(html: Column) -> Column:
    """Media elements in scan order: video and audio first, then the sources inside them."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _NOT_MARKUP, " "), F.lit(_TAG), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z]+)", 1))
    marked = F.transform(tags, lambda t, i: F.struct(
        t.alias("t"), name(t).alias("n"), t.startswith("</").alias("close"), i.alias("i")))
    depth = lambda i: F.aggregate(F.slice(marked, F.lit(1), i), F.lit(0), lambda d, m: F.when(
        m["n"] == "source", d).when(m["close"], F.greatest(d - 1, F.lit(0))).otherwise(d + 1))
    wanted = F.filter(marked, lambda m: ~m["close"] & ((m["n"] != "source") | (depth(m["i"]) > 0)))
    return F.array_sort(F.transform(wanted, lambda m: F.struct(
        F.when(m["n"] == "source", F.lit(1_000_000_000)).otherwise(F.lit(0)).__add__(m["i"]).alias("rank"),
        m["n"].alias("tag"), _attr(m["t"], "src").alias("src"), _attr(m["t"], "poster").alias("poster"),
        F.coalesce(_attr(m["t"], "title"), _attr(m["t"], "aria-label")).alias("title"))))


def scan_pages(pages: DataFrame) -> DataFrame:
    """S3: page hints from `video`, `audio` and their `source` elements, one per page, src and tag.

    Pages without such a tag are dropped first; tags are found by pattern.
    """
    candidates = pages.select("page_id", "url", "html").filter(F.col("html").rlike(r"(?i)<(?:video|audio)[\s/>]"))
    rows = candidates.select("page_id", "url", _elements_by_pattern(F.col("html")).alias("found"))
    usable = F.filter("found", lambda e: F.coalesce(
        e["src"].startswith("blob:") | e["src"].rlike(media.PAGE_MEDIA_EXT), F.lit(False)))
    rows = rows.withColumn("_usable", usable)
    keys = F.transform("_usable", lambda e: F.concat(e["src"], F.lit(":"), e["tag"]))
    rows = rows.withColumn("_once", F.filter("_usable", lambda e, i: F.array_position(keys, F.concat(e["src"], F.lit(":"), e["tag"])) == i + 1))
    rows = rows.withColumn("_base", urls.base_parts(F.col("url")))
    return rows.select("page_id", F.col("url").alias("page_url"), "_base", F.inline("_once")).select(
        "page_id", "page_url", "tag", "src", urls.resolve_against(F.col("_base"), F.col("src")).alias("url"),
        F.col("src").startswith("blob:").alias("is_blob"),
        F.when(F.col("poster").isNotNull(), urls.resolve_against(F.col("_base"), F.col("poster"))).alias("poster_url"), "title")
