"""HLS playlists as table jobs: one manifest row is read inside its row, so nothing is shuffled.

Blank lines are dropped and the rest is cut into blocks: the tag lines that precede a URI, and the URI.
A tag can so never reach past the next URI. The block pattern is possessive and anchored at the end of
the block before, which keeps it linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediatally.functions import media, urls

_BLOCK = r"\G(?:#[^\n]*\n)*+[^#\n][^\n]*(?:\n|$)"
_ATTRIBUTE = r'([A-Z0-9-]+)=("[^"]*"|[^,]*)'


def _lines(body: Column) -> Column:
    return F.transform(F.split(body, r"\r?\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))


def read_lines(manifests: DataFrame) -> DataFrame:
    """One row per trimmed line with its position."""
    return manifests.select("manifest_id", "url", F.posexplode(_lines(F.col("body"))).alias("pos", "line"))


def _pairs(line: Column) -> Column:
    names, values = (F.regexp_extract_all(line, F.lit(_ATTRIBUTE), F.lit(g)) for g in (1, 2))
    return F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), F.regexp_replace(v, r'^"|"$', "").alias("v")))


def attributes(line: Column) -> Column:
    """Attribute list as a map; quotes are removed and a later key wins."""
    pairs = _pairs(line)
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["k"]) == 0)
    return F.map_from_entries(last)


def attribute(line: Column, name: str) -> Column:
    """One attribute of a line, NULL when it is not there."""
    return F.try_element_at(F.filter(_pairs(line), lambda p: p["k"] == name), F.lit(-1))["v"]


def next_uri(lines: DataFrame) -> DataFrame:
    """For every line the next URI line after it. All lines of a partition come from one manifest row."""
    w = Window.partitionBy("manifest_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    uri = F.when((F.col("line") != "") & ~F.col("line").startswith("#"), F.col("line"))
    return lines.withColumn("next_uri", F.first(uri, ignorenulls=True).over(w))


def _last_with(tags: Column, prefix: str) -> Column:
    """Text after `prefix` of the last line that starts with it."""
    hit = F.try_element_at(F.filter(tags, lambda s: s.startswith(prefix)), F.lit(-1))
    return F.substring(hit, F.lit(len(prefix) + 1), F.length(hit))


def _tag_number(tags: Column, prefix: str, kind: str) -> Column:
    return F.coalesce(F.substring_index(_last_with(tags, prefix), ":", 1).try_cast(kind), F.lit(0).cast(kind))


def _parsed(manifests: DataFrame) -> DataFrame:
    """Manifests with `_base` (their URL's parts), `lines` (no blanks), `blocks` (tags, uri) and `playlist_type` / `parse_error`."""
    df = manifests.withColumns({"_all": _lines(F.col("body")), "_base": urls.base_parts(F.col("url"))})
    df = df.withColumn("lines", F.filter("_all", lambda s: s != ""))
    raw = F.regexp_extract_all(F.array_join("lines", "\n"), F.lit(_BLOCK), F.lit(0))
    df = df.withColumn("_raw", raw)
    block = lambda b: F.struct(
        F.filter(F.split(b, "\n"), lambda s: s.startswith("#")).alias("tags"),
        F.element_at(F.filter(F.split(b, "\n"), lambda s: (s != "") & ~s.startswith("#")), 1).alias("uri"))
    df = df.withColumn("blocks", F.transform("_raw", block))
    is_master = F.exists("lines", lambda s: s.startswith("#EXT-X-STREAM-INF"))
    kind = F.when(F.coalesce(F.get("_all", F.lit(0)).startswith("#EXTM3U"), F.lit(False)),
                  F.when(is_master, F.lit("master")).otherwise(F.lit("media"))).otherwise(F.lit("error"))
    return df.withColumn("playlist_type", kind).drop("_all", "_raw")


def _variant_array() -> Column:
    prefix = "#EXT-X-STREAM-INF:"
    bound = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.filter(b["tags"], lambda s: s.startswith(prefix)),
        lambda s: F.struct(F.substring(s, F.lit(len(prefix) + 1), F.length(s)).alias("attrs"), b["uri"].alias("uri")))))

    def variant(v: Column, i: Column) -> Column:
        res, bw = attribute(v["attrs"], "RESOLUTION"), F.nullif(attribute(v["attrs"], "BANDWIDTH"), F.lit(""))
        shape = media.resolution_of(res)
        bandwidth = bw.try_cast("bigint")
        return F.struct(
            (-shape["pixels"]).alias("_pixels"), (-F.coalesce(bandwidth, F.lit(0))).alias("_bw"), i.alias("pos"),
            F.concat(F.coalesce(res, bw, v["uri"]), F.lit("-"), i.cast("string")).alias("variant_id"),
            res.alias("resolution"), shape["label"].alias("quality_label"), shape["pixels"].alias("pixels"), bandwidth.alias("bandwidth"),
            F.nullif(attribute(v["attrs"], "CODECS"), F.lit("")).alias("codecs"),
            urls.resolve_against(F.col("_base"), v["uri"]).alias("playlist_url"))

    return F.array_sort(F.transform(bound, variant))


def hls_variants(manifests: DataFrame) -> DataFrame:
    """Variants of master playlists, rank 1 the largest picture, then the highest bandwidth, then list order.

    Playlists that are not valid, and masters without variants, give one row with `parse_error`.
    """
    df = _parsed(manifests).filter("playlist_type <> 'media'")
    df = df.withColumn("_v", F.when(F.col("playlist_type") == "master", _variant_array()))
    rows = df.select("manifest_id", "playlist_type", F.posexplode_outer("_v").alias("_r", "v"))
    error = F.when(F.col("playlist_type") == "error", F.lit("missing #EXTM3U")).when(F.col("v").isNull(), F.lit("no variants in master playlist"))
    return rows.select(
        "manifest_id", (F.col("_r") + 1).alias("rank"),
        *[F.col(f"v.{c}").alias(c) for c in ("variant_id", "resolution", "quality_label", "pixels", "bandwidth", "codecs", "playlist_url")],
        error.alias("parse_error"))


def default_variant(manifests: DataFrame) -> DataFrame:
    """The first variant after sorting."""
    return hls_variants(manifests).filter("rank = 1").drop("rank", "parse_error")


def _segment(b: Column) -> Column:
    shape = r"^#EXT-X-BYTERANGE:(\d+)(?:@(\d+))?$"
    ranged = F.try_element_at(F.filter(b["tags"], lambda s: s.rlike(shape)), F.lit(-1))
    return F.struct(
        b["uri"].alias("uri"),
        F.coalesce(F.substring_index(F.substring_index(_last_with(b["tags"], "#EXTINF:"), ":", 1), ",", 1).try_cast("double"), F.lit(0.0)).alias("duration"),
        F.regexp_extract(ranged, shape, 1).try_cast("bigint").alias("range_length"),
        F.when(ranged.isNotNull(), F.coalesce(F.regexp_extract(ranged, shape, 2).try_cast("bigint"), F.lit(0))).alias("range_offset"))


def hls_segments(manifests: DataFrame) -> DataFrame:
    """Segments of media playlists, numbered from the media sequence; one error row for playlists without any."""
    df = _parsed(manifests).filter("playlist_type <> 'master'")
    sequence = _tag_number(F.col("lines"), "#EXT-X-MEDIA-SEQUENCE:", "bigint")
    df = df.withColumn("_sequence", sequence).withColumn(
        "_s", F.when(F.col("playlist_type") == "media", F.transform("blocks", _segment)))
    rows = df.select("manifest_id", "_base", "playlist_type", "_sequence", F.posexplode_outer("_s").alias("pos", "s"))
    error = F.when(F.col("playlist_type") == "error", F.lit("missing #EXTM3U")).when(F.col("s").isNull(), F.lit("no segments in media playlist"))
    return rows.select(
        "manifest_id", "pos", F.when(F.col("s").isNotNull(), F.col("_sequence") + F.col("pos")).alias("segment_index"),
        urls.resolve_against(F.col("_base"), F.col("s.uri")).alias("segment_url"), F.col("s.duration").alias("duration_sec"),
        F.col("s.range_length").alias("range_length"), F.col("s.range_offset").alias("range_offset"), error.alias("parse_error"))


def _encryption() -> Column:
    key = _last_with(F.col("lines"), "#EXT-X-KEY:")
    method = F.upper(F.coalesce(attribute(key, "METHOD"), F.lit("none")))
    uri, iv = attribute(key, "URI"), attribute(key, "IV")
    aes = method == "AES-128"
    return F.struct(
        F.when(aes, F.lit("aes128")).when(method == "SAMPLE-AES", F.lit("sampleaes")).otherwise(F.lit("none")).alias("method"),
        F.when(aes & (F.coalesce(uri, F.lit("")) != ""), urls.resolve_url(F.col("url"), uri)).alias("key_url"),
        F.when(aes, F.regexp_replace(iv, r"^0[xX]", "")).alias("iv_hex"))


def hls_encryption(manifests: DataFrame) -> DataFrame:
    """Encryption of media playlists; the last KEY line wins."""
    df = _parsed(manifests).filter("playlist_type = 'media'").withColumn("_e", _encryption())
    return df.select("manifest_id", F.col("_e.method").alias("method"), F.col("_e.key_url").alias("key_url"), F.col("_e.iv_hex").alias("iv_hex"))


def totals_with_url(manifests: DataFrame) -> DataFrame:
    """`playlist_totals` with the playlist's URL."""
    df = _parsed(manifests).filter("playlist_type = 'media' AND size(blocks) > 0").withColumns(
        {"duration_sec": _duration(), "_e": _encryption()})
    return df.select(
        "manifest_id", "url", F.size("blocks").cast("bigint").alias("segment_count"), "duration_sec",
        (F.col("duration_sec") / F.size("blocks")).alias("avg_segment_sec"),
        _tag_number(F.col("lines"), "#EXT-X-TARGETDURATION:", "double").alias("target_sec"),
        _tag_number(F.col("lines"), "#EXT-X-MEDIA-SEQUENCE:", "bigint").alias("media_sequence"),
        _live().alias("live"), F.col("_e.method").alias("encryption"))


def _duration() -> Column:
    return F.aggregate(F.transform("blocks", lambda b: _segment(b)["duration"]), F.lit(0.0), lambda a, d: a + d)


def _live() -> Column:
    return ~F.exists("lines", lambda s: s.startswith("#EXT-X-ENDLIST"))


def playlist_totals(manifests: DataFrame) -> DataFrame:
    """A3: per media playlist segment count, total and mean duration, target duration, live flag and encryption."""
    return totals_with_url(manifests).drop("url")


def hls_states(manifests: DataFrame) -> DataFrame:
    """X24 on playlists: state of every playlist from one reading of it; one that is not valid is listed as failed."""
    df = _parsed(manifests).withColumns({"_e": _encryption(), "_live": _live()})
    listed = (F.col("playlist_type") == "media") & (F.size("blocks") > 0)
    master = (F.col("playlist_type") == "master") & F.exists("blocks", lambda b: F.exists(b["tags"], lambda s: s.startswith("#EXT-X-STREAM-INF:")))
    state = media.derive_downloadable(F.col("_e.method"), F.col("_live"))
    return df.select(
        "manifest_id", "playlist_type",
        F.when(listed, state["status"]).when(master, F.lit("ready")).otherwise(F.lit("parse_failed")).alias("status"),
        F.when(listed, state["downloadable"]).otherwise(F.lit(True)).alias("downloadable"),
        F.when(listed, state["blocked_reason"]).alias("blocked_reason"),
        F.when(listed, F.col("_e.method")).otherwise(F.lit("none")).alias("encryption"),
        F.when(listed, F.col("_live")).alias("live"), F.when(listed, _duration()).alias("duration_sec"))


def hls_items(manifests: DataFrame) -> DataFrame:
    """X24 on playlists: status of every item; a playlist that is not valid is listed as failed."""
    return hls_states(manifests).select("manifest_id", "status", "downloadable", "blocked_reason")


def cumulative_start(segments: DataFrame) -> DataFrame:
    """Presentation start of each segment. A manifest's segments come from one row, which bounds the window."""
    w = Window.partitionBy("manifest_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start_sec", F.coalesce(F.sum("duration_sec").over(w), F.lit(0.0)))


def encryption_rollup(variants: DataFrame, *, item: str) -> DataFrame:
    """The most severe encryption over an item's variants, and the item's state."""
    severity = F.when(F.col("encryption") == "sampleaes", 2).when(F.col("encryption") == "aes128", 1).otherwise(0)
    out = variants.groupBy(item).agg(F.max_by("encryption", severity).alias("encryption"), F.max("live").alias("live"))
    state = media.derive_downloadable(F.col("encryption"), F.col("live"))
    return out.withColumn("_s", state).select(item, "encryption", "live", "_s.*")


def recommended_variant(variants: DataFrame, *, item: str) -> DataFrame:
    """`recommended` marks the largest picture whose size is at most 1.5 times that of the top variant;
    `preselected` is the top one, or the second when the top is more than 3 times as large as every other.

    Variants need rank (1 is the top) and size_bytes. An item's variants come from one manifest row.
    """
    ranked = Window.partitionBy(item).orderBy("rank")
    whole = Window.partitionBy(item)
    df = variants.withColumns({
        "_top": F.first("size_bytes").over(ranked),
        "_rest": F.max(F.when(F.col("rank") > 1, F.col("size_bytes"))).over(whole),
    })
    fits = F.coalesce(F.col("size_bytes") <= 1.5 * F.col("_top"), F.col("rank") == 1)
    pick = F.min(F.when(fits, F.col("rank"))).over(whole)
    heavy = F.coalesce(F.col("_top") > 3 * F.col("_rest"), F.lit(False))
    return df.withColumns({
        "recommended": F.col("rank") == pick,
        "preselected": F.col("rank") == F.when(heavy, F.lit(2)).otherwise(F.lit(1)),
    }).drop("_top", "_rest")
