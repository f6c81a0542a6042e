"""Titles, sizes, durations, clocks, file names, durations in ISO form, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from mediatally.functions import urls
from mediatally.functions.let import let

# Characters no file name may hold, and site words that end a page title.
ILLEGAL = r'[/\\:*?"<>|\x00-\x1f]'
_SITE_SUFFIX = r"(?U)\s*[-_|]\s*(视频|高清|正版|官方|网站|官网|平台|APP|app).*$"
# Fixed value: variables a name template may use.
TEMPLATE_VARS = ["title", "site", "resolution", "quality", "bitrate", "duration", "date", "time", "index", "ext"]
DEFAULT_TEMPLATE = "{title}-{resolution}"
MAX_NAME = 150


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def clean_title(raw: Column) -> Column:
    """Page title without forbidden characters, white space squeezed, 100 characters at most."""
    return F.left(_squeeze(F.regexp_replace(raw, ILLEGAL, "")), F.lit(100))


def _clean_page_title(raw: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(raw, r'[/\\:*?"<>|]', ""), _SITE_SUFFIX, "")
    return F.left(_squeeze(text), F.lit(100))


def derive_title(page_title: Column, url: Column, detected_ms: Column, page_url: Column | None = None) -> Column:
    """Page title without site words, else the URL's name, else `host-YYYY-MM-DD` (UTC)."""
    day = F.date_from_unix_date(F.floor(detected_ms / 86400000).cast("int")).cast("string")
    site = urls.host_of(F.coalesce(page_url, url) if page_url is not None else url)
    from_url = F.nullif(urls.last_path_name(url), F.lit(""))
    return F.coalesce(
        F.nullif(_clean_page_title(page_title), F.lit("")),
        _clean_page_title(from_url),
        F.concat(F.coalesce(site, F.lit("")), F.lit("-"), day),
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of `text`, as BIGINT."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(2166136261).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )


def hash_key(text: Column) -> Column:
    """FNV-1a as eight hex digits."""
    return F.lower(F.lpad(F.hex(fnv1a(text)), 8, "0"))


def hash_key36(text: Column) -> Column:
    """FNV-1a in base 36, the id form of items built from tracks."""
    return F.lower(F.conv(fnv1a(text).cast("string"), 10, 36))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def format_bytes(size: Column) -> Column:
    """Human size; one decimal below 100 units. The unit division is exact, so tenths are computed as integers."""
    size = size.cast("double")

    def scaled(power: int, unit: str) -> Column:
        v = size / float(1024**power)
        tenths = round_half_up(v * 10)
        text = F.when(v >= 100, round_half_up(v).cast("string")).otherwise(
            F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        )
        return F.concat(text, F.lit(f" {unit}"))

    return (
        F.when(size.isNull() | F.isnan(size) | (size < 0) | (size == float("inf")), F.lit("unknown"))
        .when(size < 1024, F.concat(round_half_up(size).cast("string"), F.lit(" B")))
        .when(size < 1024.0**2, scaled(1, "KB"))
        .when(size < 1024.0**3, scaled(2, "MB"))
        .when(size < 1024.0**4, scaled(3, "GB"))
        .otherwise(scaled(4, "TB"))
    )


def _valid_seconds(sec: Column) -> Column:
    return sec.isNotNull() & ~F.isnan(sec.cast("double")) & (sec > 0) & (sec < float("inf"))


def _hms(total: Column, shape: str) -> Column:
    return F.format_string(shape, F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60)


def format_duration(sec: Column) -> Column:
    """X11: hh:mm:ss, `--:--` when unknown."""
    return F.when(_valid_seconds(sec), _hms(round_half_up(sec), "%02d:%02d:%02d")).otherwise(F.lit("--:--"))


def format_clock(ts_ms: Column) -> Column:
    """Time of day of epoch milliseconds, UTC."""
    return _hms(F.pmod(F.floor(ts_ms / 1000), F.lit(86400)).cast("bigint"), "%02d:%02d:%02d")


def _name_duration(sec: Column) -> Column:
    minutes = F.floor((sec % 3600) / 60)
    text = F.format_string("%02dh%02dm%02ds", F.floor(sec / 3600), minutes, round_half_up(sec % 60))
    return F.when(_valid_seconds(sec), text).otherwise(F.lit(""))


def _render(var: str, meta: dict[str, Column]) -> Column:
    if var not in TEMPLATE_VARS:
        return F.lit("{" + var + "}")
    value = meta.get("duration_sec" if var == "duration" else var)
    if var == "ext" or value is None:
        return F.lit("")
    if var == "title":
        rendered = _squeeze(F.regexp_replace(value, ILLEGAL, ""))
    elif var == "bitrate":
        rendered = F.when(value != 0, F.concat(round_half_up(value).cast("string"), F.lit("kbps")))
    elif var == "duration":
        rendered = _name_duration(value)
    elif var == "index":
        rendered = F.format_string("%02d", value.cast("bigint"))
        rendered = F.when(value.isNotNull(), rendered)
    else:
        rendered = value
    return F.coalesce(rendered, F.lit(""))


def _name_body(template: str, meta: dict[str, Column]) -> Column:
    pieces = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if part or i % 2:
            pieces.append(_render(part, meta) if i % 2 else F.lit(part))
    body = F.concat(*pieces) if pieces else F.lit("")
    body = F.regexp_replace(body, r"(?i)\.(mp4|webm|mkv|flv|ts|mp3|m4a|aac|mov)$", "")
    # two or more separators in a row, with white space between them or around
    body = F.regexp_replace(body, r"(?U)\s*[-_.]\s*[-_.][-_.\s]*", "-")
    body = F.regexp_replace(body, r"(?U)^[-_.\s]+|[-_.\s]+$", "")
    return F.left(body, F.lit(MAX_NAME))


def build_filename(template: str, meta: dict[str, Column]) -> Column:
    """File name from a template. `meta` maps variable names (`duration_sec` for duration) to columns.

    The template is split when the plan is built, so each variable is put in once and values that
    look like variables stay as they are. A name that comes out empty falls back to the title.
    """
    given = meta.get("ext")
    ext = F.coalesce(F.nullif(given, F.lit("")), F.lit("mp4")) if given is not None else F.lit("mp4")
    ext = F.regexp_replace(F.regexp_replace(ext, r"^\.+", ""), ILLEGAL, "")
    reduced = {k: v for k, v in meta.items() if k not in ("resolution", "quality")}
    body = F.coalesce(
        F.nullif(_name_body(template, meta), F.lit("")),
        F.nullif(_name_body(DEFAULT_TEMPLATE, reduced), F.lit("")),
        F.lit(urls.UNTITLED),
    )
    return F.concat(body, F.lit("."), ext)


def validate_template(template: Column) -> Column:
    """struct(ok, reason) for a name template."""
    reason = (
        F.when(template.isNull() | (F.regexp_replace(template, r"(?U)\s", "") == ""), F.lit("empty"))
        .when(F.length(template) > 200, F.lit("too_long"))
        .when(~(template.contains("{title}") | template.contains("{index}")),
              F.lit("not_unique"))
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def parse_iso_duration(text: Column) -> Column:
    """PnDTnHnMnS as seconds, NULL when the text has another form."""
    num = r"(\d+(?:\.\d+)?)"
    shape = rf"^P(?:{num}D)?T?(?:{num}H)?(?:{num}M)?(?:{num}S)?$"

    def part(group: int, factor: float) -> Column:
        return F.coalesce(F.regexp_extract(text, shape, group).try_cast("double"), F.lit(0.0)) * factor

    return F.when(text.rlike(shape), part(1, 86400.0) + part(2, 3600.0) + part(3, 60.0) + part(4, 1.0))


_PLACE = r"\$(RepresentationID|Bandwidth|Number|Time)(?:%0(\d+)d)?\$"


def _padded(value: Column, width: Column) -> Column:
    return F.when(value == "", value).otherwise(F.lpad(value, F.greatest(width, F.length(value)), F.lit("0")))


def template_pieces(template: Column, *, representation_id: Column, bandwidth: Column) -> Column:
    """A segment template cut at its places, as structs (`name`, `text`, `width`): the two values that are the same for all
    segments are filled in, `name` is Number or Time where a piece is left open."""
    pieces = F.regexp_extract_all(template, F.lit(rf"{_PLACE}|\$|[^$]+"), F.lit(0))

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, _PLACE, 1)
        width = F.coalesce(F.regexp_extract(piece, _PLACE, 2).try_cast("int"), F.lit(1))
        return F.struct(name.alias("name"), width.alias("width"), piece.alias("piece"))

    def settled(p: Column) -> Column:
        known = F.when(p["name"] == "RepresentationID", representation_id).otherwise(bandwidth.cast("string"))
        text = F.when(p["name"] == "", p["piece"]).when(
            p["name"].isin("RepresentationID", "Bandwidth"), let(F.coalesce(known, F.lit("")), lambda v: _padded(v, p["width"])))
        return F.struct(p["name"].alias("name"), text.alias("text"), p["width"].alias("width"))

    return F.transform(F.transform(pieces, read), settled)


def fill_pieces(pieces: Column, *, number: Column | None = None, time: Column | None = None) -> Column:
    """The text of `template_pieces` for one segment; a value that is not given is empty."""
    values = {"Number": number, "Time": time}

    def filled(p: Column) -> Column:
        text = F.when(p["text"].isNotNull(), p["text"])
        for name, value in values.items():
            if value is not None:
                text = text.when(p["name"] == name, let(F.coalesce(value.cast("string"), F.lit("")), lambda v: _padded(v, p["width"])))
        return text.otherwise(F.lit(""))

    return F.array_join(F.transform(pieces, filled), "")


def substitute_template(template: Column, *, representation_id: Column, bandwidth: Column,
                        number: Column | None = None, time: Column | None = None) -> Column:
    """Fill `$RepresentationID$`, `$Bandwidth$`, `$Number$` and `$Time$`, each place with its own optional `%0Nd` padding."""
    return fill_pieces(template_pieces(template, representation_id=representation_id, bandwidth=bandwidth), number=number, time=time)


def aes_iv(iv_hex: Column, sequence: Column) -> Column:
    """16-byte IV from up to 32 hex digits (zero-filled at the end), else the big-endian sequence number."""
    given = F.try_to_binary(F.rpad(F.left(iv_hex, F.lit(32)), 32, "0"), F.lit("hex"))
    from_sequence = F.to_binary(F.lpad(F.hex(sequence.cast("bigint")), 32, "0"), F.lit("hex"))
    return F.when(F.nullif(iv_hex, F.lit("")).isNotNull(), given).otherwise(from_sequence)
