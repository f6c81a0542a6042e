"""Per tab and page load: how many media, by protocol, with how many segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, urls
from mediatally.operators import admission, analysis, dedup, items
from mediatally.session import stage
from mediatally.sources.requests import normalize_request

SESSION = ["tab_id", "epoch"]


_LOG = ["request_id", "tab_id", "ts_ms", "method", "status_code", "kind", "url", "content_type", "content_length"]
_HINT = ["request_id", "tab_id", "ts_ms", "kind", "url", "mime", "size"]


def detected_hints(requests: DataFrame, cfg: admission.Admission, page_hints: DataFrame | None = None) -> DataFrame:
    """Hints with `reject_reason`, and single-file track requests (`is_track`).

    The dedup rule does not look at page loads, so it comes first and runs over the pushed-down scan.
    What it keeps is staged, and page loads are then counted over kept rows, track requests, page hints and load
    rows only, which gives the same numbers as counting over every request. Track requests leave before
    the media test and are not deduplicated. Page hints are neither; they pass domain rules and filters only if
    `cfg.screen_page_hints` says so.
    """
    log = requests.select(*_LOG)
    http = normalize_request(admission.admit_http(log.filter("kind = 'http'")))
    is_track = urls.is_track_url(F.col("url"))
    seen = http.filter(~is_track & media.looks_like_media(F.col("url"), F.col("mime"), F.col("has_range")))
    once = dedup.dedup_requests(seen.select(*_HINT))
    loads = log.filter("kind = 'nav'").select("request_id", "tab_id", "ts_ms", "kind")
    kept = once.withColumn("is_track", F.lit(False)).unionByName(
        http.filter(is_track).select(*_HINT, F.lit(True).alias("is_track"))).unionByName(loads, allowMissingColumns=True)
    if page_hints is not None:
        told = page_hints.filter("tab_id >= 0 AND url <> ''").select(
            *[c for c in _HINT if c != "kind"], "page_title", "parent_manifest", F.lit("page").alias("kind"), F.lit(False).alias("is_track"))
        kept = items.union_hints(kept, told)
    placed = dedup.navigation_epoch(stage(kept, "kept-requests")).filter("kind <> 'nav'")
    taken = F.lit(False) if cfg.screen_page_hints else F.col("kind") == "page"
    hosted = placed.filter(~taken).withColumn("host", urls.host_of(F.col("url"))).filter("host IS NOT NULL")
    tracks = hosted.filter("is_track")
    admitted = admission.admit_domain(hosted.filter("NOT is_track"), cfg.domains, cfg.domain_mode)
    admitted = items.keyed_hints(admitted)
    hints = admission.apply_filters(admitted, cfg).unionByName(tracks, allowMissingColumns=True)
    if page_hints is None:
        return hints
    return hints.unionByName(items.keyed_hints(placed.filter(taken)), allowMissingColumns=True)


def session_media_summary(requests: DataFrame, cfg: admission.Admission = admission.Admission(),
                          stored: DataFrame | None = None, page_hints: DataFrame | None = None) -> DataFrame:
    """The chain from a request log to session counts by protocol.

    `stored` are the manifests collected for the log (manifest_id, url, body); with them HLS and DASH items reach
    their final state, without them they count as not read yet. `page_hints` are what page scripts told (request_id, tab_id,
    ts_ms, url, mime, size, page_title, parent_manifest); with them segments may name their manifest, and every segment
    is counted once, as the log's order has it.

    The deduplicated hints are staged: merging, attribution and the filter counts all read them.
    """
    hints = stage(detected_hints(requests, cfg, page_hints), "hints")
    accepted = hints.filter("NOT is_track AND reject_reason IS NULL")
    merged = items.merge_items(accepted, session=SESSION)
    known = merged.filter("protocol <> 'progressive'")
    segments = accepted.filter("hint_kind = 'segment'")
    found = ["protocol", "status", "downloadable"]
    if page_hints is None:
        attributed = items.attribute_segments(segments, known, session=SESSION)
        named = None
    else:
        attributed, named = items.attribute_in_order(segments, known, session=SESSION)
        named = named.join(known.select(*SESSION, "dedup_key"), [*SESSION, "dedup_key"], "left_anti")
        named = named.withColumns({"status": F.lit("parsing"), "downloadable": F.lit(True)})
    owned = items.segments_per_manifest(attributed, session=SESSION)
    if stored is not None:
        merged = analysis.apply_manifests(merged, stored)
    grouped = items.track_items(items.best_tracks(hints.filter("is_track"), by=SESSION), session=SESSION)
    listed = merged.select(*SESSION, *found).unionByName(grouped.select(*SESSION, *found))
    if named is not None:
        listed = listed.unionByName(named.select(*SESSION, *found))
    counts = items.session_counts(listed, by=SESSION, protocols=["progressive", "hls", "dash"])
    filtered = hints.filter("reject_reason IS NOT NULL").groupBy(*SESSION).agg(F.count(F.lit(1)).alias("filtered_count"))
    held = owned.groupBy(*SESSION).agg(F.sum("segment_count").alias("segment_count"))
    # one shuffle by session for all three parts
    parts = counts.unionByName(filtered, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
    measures = [c for c in parts.columns if c not in SESSION]
    return parts.groupBy(*SESSION).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in measures])
