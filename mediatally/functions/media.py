"""Media classification, resolution labels, output profiles, item and task states."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediatally.functions import text, urls

# Extension patterns per media class, MIME tables and container lists.
MANIFEST_EXT = r"(?i)\.(m3u8|mpd)(\?|$)"
SEGMENT_EXT = r"(?i)\.(ts|m4s)(\?|$)"
AUDIO_EXT = r"(?i)\.(mp3|m4a|aac|ogg|opus|wav)(\?|$)"
PAGE_MEDIA_EXT = r"(?i)\.(m3u8|mpd|mp4|webm|mov|mkv|flv|ts|m4s|mp3|m4a|aac|ogg)(\?|$)"
KNOWN_VIDEO_EXT = ["mp4", "webm", "mov", "mkv", "flv", "m4v", "ts", "m4s", "avi"]
KNOWN_AUDIO_EXT = ["m4a", "mp3", "aac", "ogg", "oga", "opus", "flac", "wav"]
FILE_MIME = {
    "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "webm": "video/webm",
    "mkv": "video/x-matroska", "ts": "video/mp2t", "m4s": "video/iso.segment", "flv": "video/x-flv",
    "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac",
}
AUDIO_MIME = {
    "m4a": "audio/mp4", "mp3": "audio/mpeg", "aac": "audio/aac", "ogg": "audio/ogg",
    "oga": "audio/ogg", "opus": "audio/ogg", "flac": "audio/flac", "wav": "audio/wav",
}
MIME_AUDIO_EXT = {
    "audio/mp4": "m4a", "audio/m4a": "m4a", "audio/x-m4a": "m4a", "audio/mpeg": "mp3", "audio/mp3": "mp3",
    "audio/aac": "aac", "audio/x-aac": "aac", "audio/ogg": "ogg", "audio/opus": "ogg", "audio/flac": "flac",
    "audio/x-flac": "flac", "audio/wav": "wav", "audio/x-wav": "wav", "audio/wave": "wav",
}
QUALITY_LABELS = [(4320, "4320p"), (2160, "4K"), (1440, "2K"), (1080, "1080p"), (720, "720p"), (480, "480p"), (360, "360p")]
DASH_LABELS = [(2160, "4K"), (1080, "1080p"), (720, "720p"), (480, "480p")]
ACTIVE_STAGES = ["downloading", "decrypting", "merging", "transcoding", "queued"]
VIDEO_BRANDS = ["isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "dash", "msdh", "msix"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def looks_like_media(url: Column, mime: Column, has_range: Column) -> Column:
    """manifest or media extension, else media MIME, else a byte-range answer."""
    m = F.lower(mime)
    by_mime = m.startswith("video/") | m.startswith("audio/") | m.contains("mpegurl") | m.contains("dash+xml")
    return (
        url.rlike(PAGE_MEDIA_EXT) | F.coalesce(by_mime, F.lit(False))
        | F.coalesce(has_range, F.lit(False))
    )


def classify_hint(url: Column, mime: Column) -> Column:
    """blob / manifest / segment / progressive."""
    m = F.lower(mime)
    return (
        F.when(url.startswith("blob:"), F.lit("blob"))
        .when(url.rlike(MANIFEST_EXT), F.lit("manifest"))
        .when(m.contains("mpegurl") | m.contains("dash+xml"), F.lit("manifest"))
        .when(url.rlike(SEGMENT_EXT) | F.coalesce(m.contains("mp2t"), F.lit(False)), F.lit("segment"))
        .otherwise(F.lit("progressive"))
    )


def manifest_protocol(url: Column, mime: Column) -> Column:
    return F.when(url.rlike(r"(?i)\.mpd(\?|$)") | F.coalesce(mime.contains("dash+xml"), F.lit(False)), F.lit("dash")).otherwise(F.lit("hls"))


def media_type(url: Column, mime: Column) -> Column:
    """audio by extension or MIME, else video."""
    is_audio = url.rlike(AUDIO_EXT) | F.coalesce(mime.startswith("audio/"), F.lit(False))
    return F.when(is_audio, F.lit("audio")).otherwise(F.lit("video"))


def _label(height: Column, table: list[tuple[int, str]], last: Column) -> Column:
    out = None
    for least, name in table:
        out = F.when(height >= least, F.lit(name)) if out is None else out.when(height >= least, F.lit(name))
    return out.otherwise(last)


def resolution_of(res: Column) -> Column:
    """struct(pixels, height, label) of a `WxH` text; zeros and an empty label when it has another form."""
    shape = r"^(\d+)[xX×](\d+)$"
    w = F.coalesce(F.regexp_extract(res, shape, 1).try_cast("bigint"), F.lit(0))
    h = F.coalesce(F.regexp_extract(res, shape, 2).try_cast("bigint"), F.lit(0))
    label = F.when(F.coalesce(res.rlike(shape), F.lit(False)), _label(h, QUALITY_LABELS, F.lit("low"))).otherwise(F.lit(""))
    return F.struct((w * h).alias("pixels"), h.alias("height"), label.alias("label"))


def quality_label_dash(res: Column) -> Column:
    """The label set used for DASH variants."""
    h = F.regexp_extract(res, r"x(\d+)$", 1).try_cast("bigint")
    return F.when(h.isNull(), F.lit("")).otherwise(_label(h, DASH_LABELS, F.concat(h.cast("string"), F.lit("p"))))


def mime_for_filename(name: Column) -> Column:
    """MIME by file extension, video/mp4 when unknown."""
    ext = F.lower(F.regexp_extract(name, r"([^.]*)$", 1))
    return F.coalesce(_lookup(FILE_MIME, ext), F.lit("video/mp4"))


def output_profile(kind: Column, protocol: Column, url: Column, mime: Column, audio_output: str = "original") -> Column:
    """struct(kind, container, ext, mime) of the file an item is saved as."""
    source_ext = F.when(protocol == "progressive", urls.ext_from_url(url)).otherwise(F.lit("mp4"))
    base_mime = F.trim(F.substring_index(F.lower(mime), ";", 1))
    audio = (
        (kind == "audio")
        | F.coalesce(F.lower(mime).startswith("audio/"), F.lit(False))
        | source_ext.isin(KNOWN_AUDIO_EXT)
    )
    audio_ext = F.lit("mp3") if audio_output == "mp3" else F.coalesce(
        F.when(source_ext.isin(KNOWN_AUDIO_EXT), source_ext), _lookup(MIME_AUDIO_EXT, base_mime), F.lit("m4a"))
    video_ext = F.when(source_ext.isin(KNOWN_VIDEO_EXT), source_ext).otherwise(F.lit("mp4"))
    return F.when(
        audio,
        F.struct(F.lit("audio").alias("kind"), audio_ext.alias("container"), audio_ext.alias("ext"),
                 F.coalesce(_lookup(AUDIO_MIME, audio_ext), F.lit("audio/mp4")).alias("mime")),
    ).otherwise(
        F.struct(F.lit("video").alias("kind"), F.lit("mp4").alias("container"), video_ext.alias("ext"),
                 F.lit("video/mp4").alias("mime")))


def derive_downloadable(encryption: Column, live: Column) -> Column:
    """struct(status, downloadable, blocked_reason). Protected media is labelled, never opened."""
    live = F.coalesce(live, F.lit(False))
    status = (
        F.when(encryption == "drm", F.lit("protected"))
        .when(live, F.lit("unsupported"))
        .when(encryption == "aes128", F.lit("ready_encrypted"))
        .when(encryption == "sampleaes", F.lit("protected"))
        .otherwise(F.lit("ready"))
    )
    reason = (
        F.when(encryption == "drm", F.lit("drm")).when(live, F.lit("live"))
        .when(encryption == "sampleaes", F.lit("sampleaes"))
    )
    return F.struct(status.alias("status"), reason.isNull().alias("downloadable"), reason.alias("blocked_reason"))


def blocked_text(reason: Column, status: Column) -> Column:
    """why an item cannot be downloaded."""
    return (
        F.when(reason.isin("drm", "sampleaes"), F.lit("protected"))
        .when(reason == "live", F.lit("live"))
        .when(reason == "blob", F.lit("memory_stream"))
        .when(status == "parse_failed", F.lit("parse_failed"))
        .otherwise(F.lit("unavailable"))
    )


def session_status(items: Column, downloadable: Column, blocked: Column, parsing: Column, active_tasks: Column) -> Column:
    """struct(icon, badge) from a session's counts; `downloadable` counts listed items that are past parsing."""
    active = F.coalesce(active_tasks, F.lit(0)) > 0
    lit = F.when(active, F.lit("ring")).otherwise(F.lit("idle"))
    icon = (
        F.when(items == 0, F.when(active, F.lit("ring")).otherwise(F.lit("gray")))
        .when(blocked == items, F.lit("locked"))
        .when(downloadable > 0, lit)
        .when(parsing > 0, lit)
        .otherwise(F.lit("gray"))
    )
    badge = F.when((items > 0) & (blocked < items) & (downloadable > 0),
                   F.when(downloadable > 9, F.lit("9+")).otherwise(downloadable.cast("string")))
    return F.struct(icon.alias("icon"), badge.alias("badge"))


def empty_cause(items: Column, protected: Column, filtered: Column) -> Column:
    """Why a session lists nothing to download: protected, filtered or none."""
    return (
        F.when((protected > 0) & (items == protected), F.lit("protected"))
        .when(filtered > 0, F.lit("filtered"))
        .otherwise(F.lit("none"))
    )


def item_tags(*, resolution: Column, variant_count: Column, protocol: Column, track_count: Column,
              encryption: Column, blocked_reason: Column, status: Column) -> Column:
    """Display tags of an item, in fixed order."""
    label = resolution_of(resolution)["label"]
    quality = F.when(label != "", F.when(
        variant_count > 1, F.concat(label, F.lit(" · "), variant_count.cast("string"), F.lit(" variants"))).otherwise(label))
    tags = F.array(
        quality,
        F.when((protocol == "dash") & (track_count > 1), F.lit("dash_two_tracks")),
        F.when((protocol == "dash") & (track_count == 1), F.lit("video_only")),
        F.when(encryption == "aes128", F.lit("AES-128")),
        F.when(blocked_reason == "drm", F.lit("protected")),
        F.when(blocked_reason == "sampleaes", F.lit("sample_aes")),
        F.when(blocked_reason == "live", F.lit("live")),
        F.when(blocked_reason == "blob", F.lit("memory_stream")),
        F.when(status == "parse_failed", F.lit("parse_failed")),
        F.when(status == "parsing", F.lit("parsing")),
    )
    return F.filter(tags, lambda t: t.isNotNull())


def spec_text(resolution: Column, size: Column, url: Column) -> Column:
    """One line with resolution, size and upper-case extension; unknown parts are left out."""
    ext = F.upper(F.regexp_extract(urls.without_query(url), r"([^.]*)$", 1))
    line = F.concat_ws(" · ", F.nullif(resolution, F.lit("")), F.when(size.isNotNull(), text.format_bytes(size)),
                       F.nullif(ext, F.lit("")))
    return F.when(line == "", F.lit("unknown")).otherwise(line)


def task_progress(*, stage: Column, completed: Column, total_segments: Column, bytes_done: Column,
                  total_bytes: Column, elapsed_sec: Column) -> Column:
    """struct(pct, label, speed_bps, eta_sec); no percentage while merging or transcoding."""
    pct = (
        F.when(stage.isin("merging", "transcoding"), F.lit(None).cast("double"))
        .when(total_segments > 0, F.least(F.lit(100.0), completed / total_segments * 100))
        .when((total_bytes > 0) & (bytes_done > 0), F.least(F.lit(100.0), bytes_done / total_bytes * 100))
        .when(stage == "done", F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    names = {"queued": "waiting", "downloading": "fetching", "decrypting": "decrypting", "merging": "joining", "transcoding": "transcoding"}
    measured = (elapsed_sec > 1) & (bytes_done > 0)
    speed = F.when(measured, F.try_divide(bytes_done.cast("double"), elapsed_sec)).otherwise(F.lit(0.0))
    eta = F.when(measured & (total_bytes > 0),
                 F.greatest(F.lit(0.0), (total_bytes - bytes_done) / F.greatest(speed, F.lit(1.0))))
    return F.struct(pct.alias("pct"), F.coalesce(_lookup(names, stage), stage).alias("label"),
                    speed.alias("speed_bps"), eta.alias("eta_sec"))


def error_text(status_code: Column, message: Column) -> Column:
    """Readable text for a fetch error."""
    return (
        F.when(status_code.isin(401, 403), F.lit("credential_expired"))
        .when(status_code == 404, F.lit("not_found"))
        .when(status_code.isin(429, 503), F.lit("rate_limited"))
        .when(message == "timeout", F.lit("timed_out"))
        .when(message.contains("memory"), F.lit("out_of_memory"))
        .otherwise(F.coalesce(F.nullif(message, F.lit("")), F.lit("unknown_error")))
    )


def merge_error(error: Column) -> Column:
    """struct(text, code) for a merge error."""
    e = F.coalesce(error, F.lit("unknown_error"))
    code = (
        F.when(e.startswith("unsupported_codec"), F.lit("unsupported_codec"))
        .when(e.startswith("merge_validation_failed"), F.lit("merge_validation"))
        .otherwise(F.lit("merge_failed"))
    )
    message = (
        F.when(code == "unsupported_codec",
               F.concat(F.lit("codec: "), F.regexp_replace(e, "unsupported_codec:", "")))
        .when(code == "merge_validation", F.concat(F.lit("validation: "), e))
        .otherwise(F.concat(F.lit("merge: "), e))
    )
    return F.struct(message.alias("text"), code.alias("code"))


def merge_feasible(size_mb: Column, memory_gb: Column | None = None) -> Column:
    """struct(ok, peak_mb, watermark_mb); peak is 1.6 times the size, the mark a quarter of memory (8 GB if unknown)."""
    gb = F.coalesce(F.when(memory_gb > 0, memory_gb), F.lit(8)) if memory_gb is not None else F.lit(8)
    peak, mark = size_mb * 1.6, gb * 1024 * 0.25
    return F.struct((peak <= mark).alias("ok"), peak.alias("peak_mb"), mark.cast("double").alias("watermark_mb"))


def size_estimate(avg_segment_bytes: Column, segments: Column) -> Column:
    """Mean segment size times segment count."""
    return text.round_half_up(avg_segment_bytes * segments)


def needs_recalibration(estimate: Column, actual: Column) -> Column:
    """Whether the estimate is off by more than 30 percent."""
    return F.coalesce(F.abs(F.try_divide((actual - estimate).cast("double"), estimate.cast("double"))) > 0.3, F.lit(False))


def ftyp_brand(content: Column) -> Column:
    """struct(is_mp4, major_brand, family) from the first bytes of a file."""
    is_mp4 = (F.length(content) >= 16) & (F.substring(content, 5, 4) == F.to_binary(F.lit("ftyp"), F.lit("utf-8")))
    brand = F.when(is_mp4, F.decode(F.substring(content, 9, 4), "ISO-8859-1"))
    family = F.when(brand.isin(VIDEO_BRANDS), F.lit("video")).when(brand == "M4A ", F.lit("audio")).when(is_mp4, F.lit("other"))
    return F.struct(is_mp4.alias("is_mp4"), brand.alias("major_brand"), family.alias("family"))


def is_transmuxable(video: Column, audio: Column) -> Column:
    """H.264 video with AAC or unknown audio."""
    return (video == "h264") & audio.isin("aac", "unknown")


def input_format(first_url: Column, first_content: Column) -> Column:
    """ts or fmp4 by the first segment's URL, else by its first byte, ts when neither is known."""
    by_url = F.when(first_url.rlike(r"(?i)\.ts(\?|$)") | ~first_url.contains("m4s"), F.lit("ts")).otherwise(F.lit("fmp4"))
    by_byte = F.when(F.coalesce(F.length(first_content), F.lit(0)) == 0, F.lit("ts")).when(
        F.substring(first_content, 1, 1) == F.lit(b"\x47"), F.lit("ts")).otherwise(F.lit("fmp4"))
    return F.when(F.nullif(first_url, F.lit("")).isNotNull(), by_url).otherwise(by_byte)
