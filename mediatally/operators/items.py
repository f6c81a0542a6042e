"""From hints to media items: merging, segment attribution, track groups, session counts, item lists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from mediatally.functions import media, text, urls
from mediatally.operators.scan import Running, Spans, numbered, running
from mediatally.session import stage


def union_hints(network: DataFrame, page: DataFrame) -> DataFrame:
    """Hints of both sources; columns only one side has become NULL on the other."""
    return network.unionByName(page, allowMissingColumns=True)


def keyed_hints(hints: DataFrame) -> DataFrame:
    """Hints with `hint_kind` and `dedup_key`; columns that are there already are kept."""
    wanted = {"hint_kind": media.classify_hint(F.col("url"), F.col("mime")), "dedup_key": urls.normalize_url(F.col("url"))}
    return hints.withColumns({name: c for name, c in wanted.items() if name not in hints.columns})


def merge_items(hints: DataFrame, *, session: list[str], tie: str = "request_id") -> DataFrame:
    """A2: one item per session and normalised URL, segments left out.

    Hints need url, mime, size, ts_ms and `tie`, and may carry page_title, and hint_kind and dedup_key from `keyed_hints`.
    """
    first = F.struct("ts_ms", tie)
    df = keyed_hints(hints).filter("hint_kind <> 'segment'")
    page_title = F.col("page_title") if "page_title" in hints.columns else F.lit(None).cast("string")
    merged = df.groupBy(*session, "dedup_key").agg(
        F.min("ts_ms").alias("detected_ms"),
        F.min_by(F.struct("url", "mime", "size", F.col("hint_kind").alias("kind"), page_title.alias("page_title")), first).alias("_f"),
        F.min_by("size", F.when(F.col("size") > 0, first)).alias("_size"),
        F.count(F.lit(1)).alias("hint_count"),
    )
    kind = F.col("_f.kind")
    shown = F.when(kind != "manifest", F.nullif(text.clean_title(F.col("_f.page_title")), F.lit("")))
    title = F.coalesce(shown, urls.title_from_url(F.col("_f.url")))
    return merged.select(
        *session, "dedup_key", text.hash_key(F.col("dedup_key")).alias("item_id"), "detected_ms",
        F.col("_f.url").alias("master_url"), title.alias("title"),
        media.media_type(F.col("_f.url"), F.col("_f.mime")).alias("media_type"),
        F.when(kind == "manifest", media.manifest_protocol(F.col("_f.url"), F.col("_f.mime")))
        .otherwise(F.lit("progressive")).alias("protocol"),
        F.when(kind == "manifest", F.lit("parsing")).otherwise(F.lit("ready")).alias("status"),
        (kind != "blob").alias("downloadable"),
        F.when(kind == "blob", F.lit("blob")).alias("blocked_reason"),
        # a size that a later hint tells is the media's own only for progressive items
        F.when(kind == "progressive", F.col("_size")).when(F.col("_f.size") > 0, F.col("_f.size")).alias("size_estimate"), "hint_count",
    )


def attribute_segments(segments: DataFrame, manifests: DataFrame, *, session: list[str]) -> DataFrame:
    """Segment directories with the manifest they belong to.

    A segment belongs to the first manifest of its session whose directory contains, or lies in, the
    segment's. Segments are counted per directory first, so later steps see one row per directory.
    Each directory needs only the first manifest at one of its ancestors and the first manifest
    anywhere below it, two equality joins against one row per directory.

    `segments`: session columns and url, or dedup_key for the URL in normal form. `manifests`: session columns, dedup_key, detected_ms.
    Gives session columns, dir, segment_count, dedup_key (NULL while no manifest matches).
    """
    dirs = with_dir(segments).groupBy(*session, "dir").agg(F.count(F.lit(1)).alias("segment_count"))
    return first_manifests(dirs, manifests, F.struct("detected_ms", "dedup_key"), session=session).select(
        *session, "dir", "segment_count", F.col("first.dedup_key").alias("dedup_key"))


def with_dir(segments: DataFrame) -> DataFrame:
    """Segments with the directory of their normalised URL."""
    normal = F.col("dedup_key") if "dedup_key" in segments.columns else urls.normalize_url(F.col("url"))
    return segments.withColumn("dir", urls.dir_of(normal))


def first_manifests(dirs: DataFrame, manifests: DataFrame, rank: Column, *, session: list[str]) -> DataFrame:
    """`dirs` (one row per session and dir) with `first`, the smallest `rank` of the manifests whose directory contains, or
    lies in, the directory; NULL if there is none."""
    placed = manifests.select(*session, urls.dir_of(F.col("dedup_key")).alias("mdir"), rank.alias("m"))
    at_dir = placed.groupBy(*session, F.col("mdir").alias("anc")).agg(F.min("m").alias("m_at"))
    below = (
        placed.withColumn("dir", F.explode(urls.ancestor_dirs(F.col("mdir"))))
        .groupBy(*session, "dir").agg(F.min("m").alias("m_below"))
    )
    above = (
        dirs.select(*session, "dir", F.explode(urls.ancestor_dirs(F.col("dir"))).alias("anc"))
        .join(at_dir, [*session, "anc"]).groupBy(*session, "dir").agg(F.min("m_at").alias("m_above"))
    )
    return (
        dirs.join(above, [*session, "dir"], "left").join(below, [*session, "dir"], "left")
        .withColumn("first", F.least("m_above", "m_below")).drop("m_above", "m_below")
    )


def segments_per_manifest(attributed: DataFrame, *, session: list[str]) -> DataFrame:
    """A4: segment count of each manifest that has any."""
    return (
        attributed.filter(F.col("dedup_key").isNotNull())
        .groupBy(*session, "dedup_key").agg(F.sum("segment_count").alias("segment_count"))
    )


def attach_parent_manifest(segments: DataFrame, *, session: list[str]) -> DataFrame:
    """Items from segments that name their manifest; the manifest's URL is the item's URL, of several
    forms of it the earliest."""
    named = segments.filter(F.col("parent_manifest").isNotNull())
    named = named.withColumn("dedup_key", urls.normalize_url(F.col("parent_manifest")))
    url = F.min_by("parent_manifest", F.struct("ts_ms", "parent_manifest")).alias("master_url")
    out = named.groupBy(*session, "dedup_key").agg(
        F.min("ts_ms").alias("detected_ms"), url, F.count(F.lit(1)).alias("segment_count"))
    return out.select("*", media.manifest_protocol(F.col("master_url"), F.lit(None).cast("string")).alias("protocol"),
                      urls.title_from_url(F.col("master_url")).alias("title"))


class Attribution(NamedTuple):
    """Segments counted once (session columns, dir, dedup_key or NULL, segment_count), and the manifests known by name only
    (session columns, dedup_key, detected_ms, master_url, protocol, title)."""

    segments: DataFrame
    named: DataFrame


def attribute_in_order(segments: DataFrame, manifests: DataFrame, *, session: list[str], tie: str = "request_id") -> Attribution:
    """J1 and J2 together, as the log's order has it; every segment counts once.

    A segment belongs to the first manifest known at its time whose directory contains, or lies in, its own; else to the
    manifest it names (`parent_manifest`), which is known from then on; else it waits for the first one that fits.

    Whether a name makes a manifest known depends on what was known before, so the names are settled in rounds: each round
    takes the names that held in the round before as known and tests every (directory, name) again. A name is settled
    once those before it in time are, so rounds end; they run over one row per session, directory and name, in written
    tables, and stop when a round changes nothing. A directory's segments before its first manifest go one way and those
    after it another, so the rows themselves only meet the one row of their directory.

    `segments`: session columns, ts_ms, `tie`, url (or dedup_key for it in normal form) and parent_manifest. `manifests`: session
    columns, dedup_key and detected_ms. Segments without a time come before all others. Equal times: manifests first, then `tie`.
    """
    rows = with_dir(segments).withColumns({
        "parent": urls.normalize_url(F.col("parent_manifest")),
        "at": F.struct(F.coalesce("ts_ms", F.lit(-(2**63))).alias("ms"), F.coalesce(F.col(tie).cast("bigint"), F.lit(-(2**63))).alias("n"))})
    # read three times below: written once, rows without a name as one count per directory
    said = F.col("parent").isNotNull()
    rows = rows.groupBy(*session, "dir", "parent", F.when(said, F.col("parent_manifest")).alias("parent_manifest"), F.when(said, F.col("at")).alias("at"))
    rows = stage(rows.agg(F.count(F.lit(1)).alias("n")), "named-segments")
    hints = manifests.select(*session, "dedup_key", F.struct(
        F.coalesce("detected_ms", F.lit(-(2**63))).alias("ms"), F.lit(-(2**63)).cast("bigint").alias("n")).alias("at"))
    key = [*session, "dir", "parent"]
    earliest = F.min(F.struct("at", "parent_manifest")).alias("e")
    names = rows.filter("parent IS NOT NULL").groupBy(*key).agg(earliest).select(
        *key, F.col("e.at").alias("at"), F.col("e.parent_manifest").alias("master_url"))
    names = stage(names.withColumns({"holds": F.lit(True), "changed": F.lit(True)}), "manifest-names")
    rank = F.struct("at", "dedup_key")

    def known() -> DataFrame:
        said = names.filter("holds").select(*session, F.col("parent").alias("dedup_key"), "at")
        return hints.unionByName(said).groupBy(*session, "dedup_key").agg(F.min("at").alias("at"))

    while names.filter("changed").limit(1).count():
        dirs = first_manifests(names.select(*session, "dir").distinct(), known(), rank, session=session)
        holds = F.coalesce(F.col("at") <= F.col("first.at"), F.lit(True))
        tested = names.withColumnRenamed("holds", "held").join(dirs, [*session, "dir"]).withColumn("holds", holds)
        names = stage(tested.select(*key, "at", "master_url", "holds", (F.col("held") != F.col("holds")).alias("changed")), "manifest-names")

    # only what no hint had made known before is an item by name alone
    said = names.filter("holds").groupBy(*session, F.col("parent").alias("dedup_key")).agg(F.min(F.struct("at", "master_url")).alias("e"))
    seen = hints.groupBy(*session, "dedup_key").agg(F.min("at").alias("hinted"))
    said = said.join(seen, [*session, "dedup_key"], "left").filter(F.col("hinted").isNull() | (F.col("e.at") < F.col("hinted")))
    url = F.col("e.master_url")
    named = said.select(
        *session, "dedup_key", F.col("e.at.ms").alias("detected_ms"), url.alias("master_url"),
        media.manifest_protocol(url, F.lit(None).cast("string")).alias("protocol"), urls.title_from_url(url).alias("title"))

    # the first manifest of each directory, then each row or count goes to it, to its name, or waits
    unnamed = rows.filter("parent IS NULL").select(*session, "dir", "n")
    dirs = unnamed.select(*session, "dir").union(names.select(*session, "dir")).distinct()
    dirs = stage(first_manifests(dirs, known(), rank, session=session), "first-manifests")
    waiting = unnamed.join(dirs, [*session, "dir"], "left").select(*session, "dir", F.col("first.dedup_key").alias("dedup_key"), "n")
    fits = F.coalesce(F.col("first.at") < F.col("at"), F.lit(False))
    owner = F.when(fits, F.col("first.dedup_key")).otherwise(F.col("parent"))
    naming = rows.filter("parent IS NOT NULL").join(dirs, [*session, "dir"], "left").groupBy(*session, "dir", owner.alias("dedup_key")).agg(
        F.sum("n").alias("n"))
    counted = waiting.unionByName(naming).groupBy(*session, "dir", "dedup_key").agg(F.sum("n").alias("segment_count"))
    return Attribution(counted, named)


def best_tracks(requests: DataFrame, *, by: list[str], tie: str = "request_id") -> DataFrame:
    """Highest codec per session, group and track type; groups without video are not listed.

    The first URL seen with that codec stays.
    """
    parsed = requests.withColumn("_t", urls.parse_track_url(F.col("url"))).filter(F.col("_t").isNotNull())
    rows = parsed.select(*by, F.col("_t.group_id").alias("group_id"), F.col("_t.codec_id").alias("codec_id"),
                         F.col("_t.track_type").alias("track_type"), "url", "ts_ms", tie)
    better = F.struct(F.col("codec_id"), -F.col("ts_ms"), -F.col(tie))

    def best(kind: str) -> Column:
        return F.max_by(F.struct("codec_id", "url"), F.when(F.col("track_type") == kind, better))

    return (
        rows.groupBy(*by, "group_id")
        .agg(best("video").alias("v"), best("audio").alias("a"), F.min("ts_ms").alias("detected_ms"))
        .filter(F.col("v").isNotNull())
        .select(*by, "group_id", "detected_ms", F.col("v.codec_id").alias("video_codec"), F.col("v.url").alias("video_url"),
                F.col("a.codec_id").alias("audio_codec"), F.col("a.url").alias("audio_url"))
    )


def track_items(tracks: DataFrame, *, session: list[str]) -> DataFrame:
    """Items from track groups; a group without audio is marked silent."""
    key = F.concat(F.lit("nolist:"), F.col("group_id"))
    return tracks.select(
        *session, key.alias("dedup_key"),
        text.hash_key36(F.concat(F.col("tab_id").cast("string"), F.lit(":"), key)).alias("item_id"),
        "detected_ms", F.col("video_url").alias("master_url"), F.lit("dash").alias("protocol"),
        F.lit("ready").alias("status"), F.lit(True).alias("downloadable"),
        (F.lit(1) + F.col("audio_codec").isNotNull().cast("int")).alias("track_count"),
        F.col("audio_codec").isNotNull().alias("dual"), F.col("audio_codec").isNull().alias("silent"),
        F.concat(F.lit("v"), F.col("video_codec").cast("string")).alias("video_track"),
        F.concat(F.lit("a"), F.col("audio_codec").cast("string")).alias("audio_track"),
    )


def pair_tracks(video: DataFrame, audio: DataFrame, *, keys: list[str]) -> DataFrame:
    """J9 on separate sides: each group's highest-codec video with its highest-codec audio.

    Both sides shrink to one row per group before they meet. `track_state` is dual, silent or no_video.
    """
    v = video.groupBy(*keys).agg(F.max("codec_id").alias("video_codec"))
    a = audio.groupBy(*keys).agg(F.max("codec_id").alias("audio_codec"))
    state = (
        F.when(F.col("video_codec").isNull(), F.lit("no_video"))
        .when(F.col("audio_codec").isNull(), F.lit("silent")).otherwise(F.lit("dual"))
    )
    return v.join(a, keys, "full_outer").withColumn("track_state", state)


def await_audio(tracks: DataFrame, *, keys: list[str], width: int, wait_ms: int = 12_000,
                tie: str = "request_id") -> DataFrame:
    """Each video row with the first audio row of its group at or within `wait_ms` after it.

    One ordered scan gives every row the next audio; no pairs are formed. At equal times video sorts first.
    """
    df = tracks.withColumn("_audio_last", (F.col("track_type") == "audio").cast("int"))
    audio = F.when(F.col("track_type") == "audio", F.struct(F.col("ts_ms").alias("ts"), F.col("codec_id").alias("codec")))
    scanned = running(df, keys=keys, order=["ts_ms", "_audio_last", tie], bucket=Spans("ts_ms", width),
                      _next=Running("next", audio))
    near = F.when(F.col("_next.ts") - F.col("ts_ms") <= wait_ms, F.col("_next"))
    return scanned.filter("track_type = 'video'").select(
        *[c for c in tracks.columns if c != "track_type"],
        near["ts"].alias("audio_ts_ms"), near["codec"].alias("audio_codec"), near.isNull().alias("silent"))


def session_counts(items: DataFrame, *, by: list[str], protocols: list[str] | None = None) -> DataFrame:
    """Per session the listed, downloadable, protected and parsing counts, and items per protocol when asked for."""
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("downloadable") & ~F.col("status").isin("parsing", "hint")).alias("downloadable_count"),
        F.count_if(~F.col("downloadable")).alias("protected_count"),
        F.count_if(F.col("status") == "parsing").alias("parsing_count"),
        *[F.count_if(F.col("protocol") == p).alias(f"{p}_count") for p in protocols or []],
    )


def session_summary(items: DataFrame, *, by: list[str], rejected: DataFrame | None = None) -> DataFrame:
    """A1: session counts with the number of filtered hints. Protected counts items, not updates."""
    out = session_counts(items, by=by)
    if rejected is None:
        return out.withColumn("filtered_count", F.lit(0).cast("bigint"))
    dropped = rejected.groupBy(*by).agg(F.count(F.lit(1)).alias("filtered_count"))
    counts = ["item_count", "downloadable_count", "protected_count", "parsing_count", "filtered_count"]
    return out.join(dropped, by, "full_outer").select(*by, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def upsert_items(updates: DataFrame, *, keys: list[str], order: list[str], first: str) -> DataFrame:
    """Latest fields per key by `order`; `first` keeps its earliest value."""
    latest = F.max_by(F.struct(*[c for c in updates.columns if c not in [*keys, first]]), F.struct(*order)).alias("_l")
    return updates.groupBy(*keys).agg(latest, F.min(first).alias(first)).select(*keys, first, "_l.*")


def first_seen_order(items: DataFrame, *, session: list[str], detected: str, item: str) -> DataFrame:
    """Items in the order they were first seen, as a range-partitioned global sort."""
    return items.orderBy(*session, detected, item)


def filter_type(items: DataFrame, kind: str) -> DataFrame:
    """all, video or audio."""
    return items if kind == "all" else items.filter(F.col("media_type") == kind)


def search_items(items: DataFrame, query: str) -> DataFrame:
    """F8: title, shown duration or shown size contains the text, ignoring case."""
    q = query.strip().lower()
    if not q:
        return items
    hit = (
        F.lower("title").contains(q)
        | F.coalesce(F.col("duration_sec").isNotNull() & text.format_duration(F.col("duration_sec")).contains(q), F.lit(False))
        | F.coalesce(F.col("size_bytes").isNotNull() & F.lower(text.format_bytes(F.col("size_bytes"))).contains(q), F.lit(False))
    )
    return items.filter(hit)


def smart_search(items: DataFrame, query: str) -> DataFrame:
    """a number means megabytes (same whole part), mm:ss a duration within ten percent, other text a title."""
    q = query.strip().lower()
    if q.replace(".", "", 1).isdigit():
        mb = float(q)
        size = F.col("size_bytes") / float(1024 * 1024)
        return items.filter((size >= int(mb)) & (size < int(mb) + 1))
    minutes, sep, seconds = q.partition(":")
    if sep and minutes.isdigit() and seconds.isdigit():
        target = int(minutes) * 60 + int(seconds)
        return items.filter(F.abs(F.col("duration_sec") - target) * 10 <= target)
    return items.filter(F.lower("title").contains(q))


def downloadable_only(items: DataFrame) -> DataFrame:
    """items that can be downloaded."""
    return items.filter("downloadable")


def explain_blocked(items: DataFrame) -> DataFrame:
    """the other items with the reason."""
    return items.filter(~F.col("downloadable")).withColumn("why", media.blocked_text(F.col("blocked_reason"), F.col("status")))


def sort_items(items: DataFrame, field: str, descending: bool, *, tie: str) -> DataFrame:
    """T4: by size, resolution (pixels) or time; unknown values last either way."""
    key = {
        "size": F.col("size_bytes"),
        "resolution": F.nullif(media.resolution_of(F.col("resolution"))["pixels"], F.lit(0)),
        "time": F.col("detected_ms"),
    }[field]
    return items.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def cap_list(items: DataFrame, n: int = 200, *, session: list[str], order: list[str], width: int) -> DataFrame:
    """The first `n` items of each session are listed, the rest marked folded."""
    ranked = numbered(items, keys=session, order=order, bucket=Spans(order[0], width))
    return ranked.withColumn("folded", F.col("rank") > n)


def batch_index(items: DataFrame, *, batch: list[str], order: list[str], width: int) -> DataFrame:
    """1-based number of each downloadable item of a batch; other items are left out."""
    picked = downloadable_only(items)
    return numbered(picked, keys=batch, order=order, bucket=Spans(order[0], width), name="batch_index")


def nest_items(variants: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """Variant rows as one array per item, in `order`. An item's variants come from one manifest row."""
    entry = F.struct(*order, *[c for c in variants.columns if c not in [key, *order]])
    return variants.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("variants"))


def flatten_items(items: DataFrame, *, key: str) -> DataFrame:
    """Nested variants back to rows; items without variants keep one row of NULLs."""
    return items.select(key, F.inline_outer("variants"))


def freeze_snapshot(items: DataFrame, *, key: list[str]) -> DataFrame:
    """Every item as JSON text stored with its task."""
    return items.select(*key, F.to_json(F.struct(*[c for c in items.columns if c not in key])).alias("snapshot"))


def thaw_snapshot(frozen: DataFrame, schema: str, *, key: list[str]) -> DataFrame:
    """The stored fields back as columns."""
    return frozen.select(*key, F.from_json("snapshot", schema).alias("_s")).select(*key, "_s.*")
