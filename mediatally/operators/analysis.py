"""What stored manifests say about media items: state, duration, encryption, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, urls
from mediatally.operators import dash, hls

_STATE = ["status", "downloadable", "blocked_reason", "encryption", "live", "duration_sec", "variant_count"]


def probe_variants(variants: DataFrame, playlists: DataFrame) -> DataFrame:
    """Variants with the duration, segment count, mean segment length, encryption and live flag of their own playlist.

    `variants` as from `hls_variants`; `playlists`: manifest_id, url, body. Of several playlists with one URL the first
    by manifest_id counts. A variant whose playlist is absent, or is no media playlist, keeps NULLs.
    """
    names = ["duration_sec", "segment_count", "avg_segment_sec", "encryption", "live"]
    probed = hls.totals_with_url(playlists).groupBy("url").agg(F.min_by(F.struct(*names), "manifest_id").alias("_p"))
    joined = variants.join(probed, F.col("playlist_url") == F.col("url"), "left")
    return joined.select(*variants.columns, *[F.col(f"_p.{c}").alias(c) for c in names])


def _hls_states(manifests: DataFrame, playlists: DataFrame) -> DataFrame:
    """One row per playlist. A master takes over the most severe encryption its variants' playlists show."""
    states = hls.hls_states(manifests)
    variants = hls.hls_variants(manifests).filter("parse_error IS NULL")
    probed = probe_variants(variants.select("manifest_id", "playlist_url"), playlists)
    found = probed.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("encryption") == "sampleaes", 2).when(F.col("encryption") == "aes128", 1).otherwise(0)).alias("_severity"))
    joined = states.join(found, "manifest_id", "left")
    seen = F.element_at(F.array(F.lit("none"), F.lit("aes128"), F.lit("sampleaes")), F.col("_severity") + 1)
    raised = F.col("playlist_type").eqNullSafe("master") & (F.col("_severity") > 0)
    state = media.derive_downloadable(seen, F.lit(False))
    return joined.select(
        "manifest_id", F.when(raised, state["status"]).otherwise(F.col("status")).alias("status"),
        F.when(raised, state["downloadable"]).otherwise(F.col("downloadable")).alias("downloadable"),
        F.when(raised, state["blocked_reason"]).otherwise(F.col("blocked_reason")).alias("blocked_reason"),
        F.when(raised, seen).otherwise(F.col("encryption")).alias("encryption"), "live", "duration_sec",
        F.coalesce("_n", F.when(F.col("playlist_type") == "media", 1), F.lit(0)).cast("bigint").alias("variant_count"))


def _dash_states(manifests: DataFrame) -> DataFrame:
    count = F.coalesce(F.size("variants"), F.lit(0))
    return dash.dash_items(manifests).select(
        "manifest_id", "status", "downloadable", "blocked_reason", "encryption", "live", "duration_sec",
        F.greatest(count, F.lit(0)).cast("bigint").alias("variant_count"))


def apply_manifests(items: DataFrame, manifests: DataFrame, playlists: DataFrame | None = None) -> DataFrame:
    """Items with the state their stored manifest gives them; items without one, and progressive ones, stay as they are.

    `items` need dedup_key, protocol, status, downloadable and blocked_reason. `manifests`: manifest_id, url, body; one is
    an item's if its normalised URL is the item's key, the first by manifest_id if there are several. `playlists` hold the
    variants' playlists, by default the manifests do. Adds encryption, live, duration_sec and variant_count.
    """
    playlists = manifests if playlists is None else playlists
    kind = media.manifest_protocol(F.col("url"), F.lit(None).cast("string"))
    keyed = manifests.withColumn("_kind", kind)
    states = _hls_states(keyed.filter("_kind = 'hls'").drop("_kind"), playlists).unionByName(
        _dash_states(keyed.filter("_kind = 'dash'").drop("_kind")))
    keys = keyed.select("manifest_id", urls.normalize_url(F.col("url")).alias("_key"), "_kind")
    found = keys.join(states, "manifest_id").groupBy("_key", "_kind").agg(F.min_by(F.struct(*_STATE), "manifest_id").alias("_m"))
    joined = items.join(found, (F.col("dedup_key") == F.col("_key")) & (F.col("protocol") == F.col("_kind")), "left")
    known = F.col("_m").isNotNull()
    over = {c: F.when(known, F.col(f"_m.{c}")).otherwise(F.col(c)) if c in items.columns else F.col(f"_m.{c}") for c in _STATE}
    return joined.select(*[over[c].alias(c) if c in over else F.col(c) for c in items.columns],
                         *[over[c].alias(c) for c in _STATE if c not in items.columns])
