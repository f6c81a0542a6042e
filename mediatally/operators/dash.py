"""DASH manifests as table jobs: XML to structs inside the row, then representations and segments as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mediatally.functions import media, text, urls

_TIMELINE = "struct<S:array<struct<_t:string,_d:string,_r:string>>>"
_TEMPLATE = (
    "struct<_timescale:string,_duration:string,_startNumber:string,_initialization:string,_media:string,"
    f"SegmentTimeline:{_TIMELINE}>"
)
_LIST = (
    "struct<_timescale:string,_duration:string,Initialization:struct<_sourceURL:string>,"
    "SegmentURL:array<struct<_media:string>>>"
)
_PROTECTION = "array<struct<_schemeIdUri:string>>"
_REPRESENTATION = (
    "struct<_id:string,_bandwidth:string,_width:string,_height:string,_codecs:string,_mimeType:string,_lang:string,"
    f"AudioChannelConfiguration:array<struct<_value:string>>,ContentProtection:{_PROTECTION},"
    f"SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST}>"
)
_SET = (
    f"struct<_contentType:string,_mimeType:string,_lang:string,ContentProtection:{_PROTECTION},"
    f"SegmentTemplate:{_TEMPLATE},SegmentList:{_LIST},Representation:array<{_REPRESENTATION}>>"
)
MPD_SCHEMA = (
    f"_type string, _mediaPresentationDuration string, Period array<struct<AdaptationSet:array<{_SET}>>>"
)


def read_mpd(manifests: DataFrame) -> DataFrame:
    """Manifests with the parsed `mpd` struct and `parse_error`."""
    mpd = F.from_xml(F.col("body"), MPD_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    looks = F.col("body").rlike(r"<(?:[A-Za-z_][\w.\-]*:)?MPD[\s/>]")
    df = manifests.withColumn("mpd", mpd)
    broken = F.col("mpd").isNull() | (F.col("mpd._type").isNull() & F.col("mpd._mediaPresentationDuration").isNull() & F.col("mpd.Period").isNull())
    error = F.when(~looks, F.lit("no MPD element")).when(broken, F.lit("xml parse error"))
    return df.withColumn("parse_error", error)


def _number(value: Column, kind: str = "double") -> Column:
    return value.try_cast(kind)


def _representation(s: Column, r: Column) -> Column:
    content = F.coalesce(s["_contentType"], F.substring_index(F.coalesce(s["_mimeType"], F.lit("")), "/", 1))
    mime = F.coalesce(r["_mimeType"], s["_mimeType"], F.lit(""))
    is_audio = (content == "audio") | mime.startswith("audio/") | (F.coalesce(F.size(r["AudioChannelConfiguration"]), F.lit(0)) > 0)
    tpl = F.coalesce(r["SegmentTemplate"], s["SegmentTemplate"])
    lst = F.when(tpl.isNull(), F.coalesce(r["SegmentList"], s["SegmentList"]))
    scale = F.coalesce(F.nullif(_number(F.coalesce(tpl["_timescale"], lst["_timescale"])), F.lit(0.0)), F.lit(1.0))
    protected = (F.coalesce(F.size(s["ContentProtection"]), F.lit(0)) > 0) | (F.coalesce(F.size(r["ContentProtection"]), F.lit(0)) > 0)
    listed = F.filter(F.transform(lst["SegmentURL"], lambda u: u["_media"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return F.struct(
        r["_id"].alias("id"), F.when(is_audio, F.lit("audio")).otherwise(F.lit("video")).alias("track_type"),
        _number(r["_bandwidth"], "bigint").alias("bandwidth"),
        F.when((F.coalesce(r["_width"], F.lit("")) != "") & (F.coalesce(r["_height"], F.lit("")) != ""),
               F.concat(r["_width"], F.lit("x"), r["_height"])).alias("resolution"),
        r["_codecs"].alias("codecs"), F.coalesce(s["_lang"], r["_lang"]).alias("lang"), protected.alias("protected"),
        F.when(tpl.isNotNull() | lst.isNotNull(), scale).alias("timescale"),
        _number(F.coalesce(tpl["_duration"], lst["_duration"])).alias("segment_duration"),
        _number(tpl["_startNumber"], "bigint").alias("start_number"),
        tpl["_initialization"].alias("init_template"), tpl["_media"].alias("media_template"),
        lst["Initialization"]["_sourceURL"].alias("init_url"), listed.alias("listed_urls"),
        F.transform(tpl["SegmentTimeline"]["S"], lambda e: F.struct(
            _number(e["_t"], "bigint").alias("t"), F.coalesce(_number(e["_d"], "bigint"), F.lit(0)).alias("d"),
            _number(e["_r"], "bigint").alias("r"))).alias("timeline"))


def _with_representations(manifests: DataFrame) -> DataFrame:
    """Manifests with live, duration_sec and the array `reps`; a manifest without any gets an error."""
    present = lambda arrays: F.flatten(F.filter(arrays, lambda a: a.isNotNull()))
    reps = present(F.transform("mpd.Period", lambda p: present(F.transform(
        p["AdaptationSet"], lambda s: F.transform(s["Representation"], lambda r: _representation(s, r))))))
    df = read_mpd(manifests).withColumn("reps", reps)
    df = df.withColumn("reps", F.transform("reps", lambda r, i: r.withField(
        "id", F.coalesce(r["id"], F.concat(F.lit("rep-"), i.cast("string"))))))
    none = F.coalesce(F.size("reps"), F.lit(0)) <= 0
    return df.select(
        "manifest_id", "url", "reps",
        F.coalesce("parse_error", F.when(none, F.lit("no representations"))).alias("parse_error"),
        (F.coalesce("mpd._type", F.lit("static")) == "dynamic").alias("live"),
        text.parse_iso_duration(F.col("mpd._mediaPresentationDuration")).alias("duration_sec"))


def mpd_representations(manifests: DataFrame) -> DataFrame:
    """One row per representation, one error row for a manifest that gives none."""
    df = _with_representations(manifests)
    df = df.withColumn("reps", F.when(F.col("parse_error").isNull(), F.col("reps")))
    return df.select("manifest_id", "url", "live", "duration_sec", "parse_error", F.posexplode_outer("reps").alias("pos", "r")).select(
        "manifest_id", "url", "live", "duration_sec", "parse_error", "pos", F.col("r.id").alias("rep_id"),
        *[F.col(f"r.{c}").alias(c) for c in (
            "track_type", "bandwidth", "resolution", "codecs", "lang", "protected", "timescale", "segment_duration",
            "start_number", "init_template", "media_template", "init_url", "listed_urls", "timeline")])


def drm_flag(representations: DataFrame) -> DataFrame:
    """Whether any set or representation of a manifest is protected."""
    return representations.filter("parse_error IS NULL").groupBy("manifest_id").agg(F.max("protected").alias("drm"))


def _mode() -> Column:
    return (
        F.when(F.col("listed_urls").isNotNull(), F.lit("list")).when(F.col("media_template").isNull(), F.lit("none"))
        .when(F.coalesce(F.size("timeline"), F.lit(0)) > 0, F.lit("timeline")).otherwise(F.lit("number")))


def _number_count(duration: Column, timescale: Column, segment_duration: Column) -> Column:
    return F.coalesce(F.ceil(F.try_divide(F.coalesce(duration, F.lit(0.0)) * timescale, segment_duration)).cast("bigint"), F.lit(0))


def _prepared(representations: DataFrame) -> DataFrame:
    """Representations with their template cut into pieces and the parts of their base URL: once each, before the segments."""
    pieces = text.template_pieces(F.col("media_template"), representation_id=F.col("rep_id"), bandwidth=F.coalesce("bandwidth", F.lit(0)))
    return representations.withColumns({"_pieces": pieces, "_base": urls.base_parts(F.col("url"))})


def _segment_rows(rows: DataFrame) -> DataFrame:
    filled = text.fill_pieces(F.col("_pieces"), number=F.col("number"), time=F.col("time"))
    return rows.withColumn("segment_url", urls.resolve_against(F.col("_base"), filled)).select(_SEGMENT)


_SEGMENT = ["manifest_id", "rep_id", "segment_index", "number", "time", "segment_url"]


def expand_number_template(representations: DataFrame) -> DataFrame:
    """`$Number$` segments; their count follows from the duration. Rows stay compact until this explode."""
    start = F.coalesce("start_number", F.lit(1))
    df = representations.filter(_mode() == "number").withColumn(
        "_n", _number_count(F.col("duration_sec"), F.col("timescale"), F.col("segment_duration"))).filter("_n > 0")
    rows = _prepared(df).withColumn("segment_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return _segment_rows(rows.withColumns({"number": start + F.col("segment_index"), "time": F.lit(None).cast("bigint")}))


def _repeats(e: Column, segment_duration: Column, honor_r: bool) -> Column:
    if honor_r:
        return F.greatest(F.coalesce(e["r"], F.lit(0)), F.lit(0)) + 1
    per = F.coalesce(segment_duration, F.nullif(e["d"], F.lit(0)).cast("double"), F.lit(1.0))
    return F.greatest(F.lit(1), text.round_half_up(F.coalesce(F.try_divide(e["d"].cast("double"), per), F.lit(0.0)))).cast("bigint")


def expand_timeline(representations: DataFrame, honor_r: bool = False) -> DataFrame:
    """Timeline segments with running time and number.

    By default an entry repeats by its length over the segment duration; `honor_r` follows the `@r`
    repeat count and later `@t` starts instead. Entries become rows, and running sums per representation give
    each its first number and time, so the work goes with the number of entries.
    """
    df = _prepared(representations.filter(_mode() == "timeline"))
    first = F.coalesce(F.element_at("timeline", 1)["t"], F.lit(0)).cast("bigint")
    entries = df.select(
        "manifest_id", "rep_id", "pos", "start_number", "segment_duration", "_pieces", "_base", first.alias("_first"),
        F.posexplode("timeline").alias("_at", "_e")).withColumn("_c", _repeats(F.col("_e"), F.col("segment_duration"), honor_r))
    before = Window.partitionBy("manifest_id", "pos").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = entries.withColumns({
        "_n": F.coalesce(F.sum("_c").over(before), F.lit(0)),
        "_passed": F.coalesce(F.sum(F.col("_e.d") * F.col("_c")).over(before), F.lit(0))})
    start = F.col("_first") + F.col("_passed")
    if honor_r:
        given = F.when(F.col("_e.t").isNotNull(), F.col("_e.t") - F.col("_passed"))
        runs = runs.withColumn("_given", F.last(given, ignorenulls=True).over(upto))
        start = F.coalesce("_given", "_first") + F.col("_passed")
    runs = runs.withColumn("_t", start)
    rows = runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1)))
    return _segment_rows(rows.withColumns({
        "segment_index": F.col("_n") + F.col("_i"),
        "number": F.coalesce("start_number", F.lit(1)) + F.col("_n") + F.col("_i"),
        "time": F.col("_t") + F.col("_i") * F.col("_e.d")}))


def expand_segment_list(representations: DataFrame) -> DataFrame:
    """Explicitly listed segments."""
    rows = representations.filter(_mode() == "list").select("*", F.posexplode("listed_urls").alias("_i", "_u"))
    return rows.select("manifest_id", "rep_id", F.col("_i").cast("bigint").alias("segment_index"),
                       F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("bigint").alias("time"),
                       urls.resolve_url(F.col("url"), F.col("_u")).alias("segment_url"))


def init_segments(representations: DataFrame) -> DataFrame:
    """Init segment of each representation that names one."""
    filled = text.substitute_template(F.col("init_template"), representation_id=F.col("rep_id"), bandwidth=F.coalesce("bandwidth", F.lit(0)))
    url = F.coalesce(F.when(F.coalesce("init_template", F.lit("")) != "", urls.resolve_url(F.col("url"), filled)),
                     F.when(F.coalesce("init_url", F.lit("")) != "", urls.resolve_url(F.col("url"), F.col("init_url"))))
    return representations.select("manifest_id", "rep_id", url.alias("init_segment_url")).filter("init_segment_url IS NOT NULL")


def dash_segments(representations: DataFrame, honor_r: bool = False) -> DataFrame:
    """N6-N8 together."""
    return expand_number_template(representations).unionByName(expand_timeline(representations, honor_r)).unionByName(
        expand_segment_list(representations))


def _segment_total(r: Column) -> Column:
    timeline = F.aggregate(r["timeline"], F.lit(0).cast("bigint"), lambda a, e: a + _repeats(e, r["segment_duration"], False))
    return (
        F.when(r["listed_urls"].isNotNull(), F.size(r["listed_urls"]).cast("bigint"))
        .when(r["media_template"].isNull(), F.lit(0).cast("bigint"))
        .when(F.coalesce(F.size(r["timeline"]), F.lit(0)) > 0, timeline)
        .otherwise(_number_count(F.col("duration_sec"), r["timescale"], r["segment_duration"])))


def dash_items(manifests: DataFrame) -> DataFrame:
    """One item per manifest with its sorted variants (video) and tracks (first video, then all audio).

    Everything is computed inside the row; segments are tied to representations by id. A live manifest is unsupported.
    """
    df = _with_representations(manifests)
    height = lambda r: F.coalesce(F.regexp_extract(r["resolution"], r"x(\d+)$", 1).try_cast("bigint"), F.lit(0))
    videos = F.filter("reps", lambda r: r["track_type"] == "video")
    audios = F.filter("reps", lambda r: r["track_type"] == "audio")
    variants = F.array_sort(F.transform(videos, lambda r, i: F.struct(
        (-height(r)).alias("_h"), (-F.coalesce(r["bandwidth"], F.lit(0))).alias("_b"), i.alias("_i"), r["id"].alias("variant_id"),
        r["resolution"].alias("resolution"), media.quality_label_dash(r["resolution"]).alias("quality_label"),
        r["bandwidth"].alias("bandwidth"), r["codecs"].alias("codecs"), _segment_total(r).alias("segment_count"))))
    tracks = F.transform(F.concat(F.slice(videos, 1, 1), audios), lambda r: F.struct(
        r["id"].alias("track_id"), r["track_type"].alias("track_type"), r["lang"].alias("lang"), _segment_total(r).alias("segment_count")))
    drm = F.exists("reps", lambda r: r["protected"])
    failed = F.col("parse_error").isNotNull()
    state = media.derive_downloadable(F.when(drm, F.lit("drm")).otherwise(F.lit("none")), F.col("live"))
    open_ = ~failed & ~F.coalesce(drm, F.lit(False))
    return df.withColumns({"_state": state, "_open": open_}).select(
        "manifest_id",
        F.when(failed, F.lit("parse_failed")).otherwise(F.col("_state.status")).alias("status"),
        F.when(failed, F.lit("none")).when(drm, F.lit("drm")).otherwise(F.lit("none")).alias("encryption"),
        F.when(failed, F.lit(True)).otherwise(F.col("_state.downloadable")).alias("downloadable"),
        F.when(~failed, F.col("_state.blocked_reason")).alias("blocked_reason"),
        F.when(~failed, F.col("live")).alias("live"), F.when(~failed, F.col("duration_sec")).alias("duration_sec"),
        F.when(F.col("_open"), variants).alias("variants"), F.when(F.col("_open"), tracks).alias("tracks"), "parse_error")
