"""URL columns: canonical form, directory, host, title, extension, relative resolution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediatally.functions.let import let

# Query parameters that change per request and do not identify the media.
VOLATILE_PARAMS = ["_t", "_ts", "token", "expire", "expires", "sign", "signature", "auth_key"]
# Fixed value: title of media whose URL gives none.
UNTITLED = "未命名媒体"

_WEB = (
    r"^((?i:https?|wss?|ftp))://([^/?#@\s]*@)?(\[[^\]\s]*\]|[^/?#:@\s]+)(?::(\d*))?(?=[/?#]|$)"
    r"(/[^?#]*)?(\?[^#]*)?(#.*)?$"
)
_HOST = r"^(?i:https?|wss?|ftp)://(?:[^/?#@\s]*@)?(\[[^\]\s]*\]|[^/?#:@\s]+)(?::\d*)?(?=[/?#]|$)"
_PATH = r"^(?:(?i:https?|wss?|ftp)://[^/?#\s]+|(?!(?i:https?|wss?|ftp):)[A-Za-z][A-Za-z0-9+.\-]*:)([^?#]*)"
_ANY_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# https://host/path with nothing left to canonicalise
_PLAIN = r"^https?://[a-z0-9.\-]+/(?!\.)(?:[!#-.0-;=?-_a-z|~]|/(?!\.))*$"
_CUT = "\n"


def _match(url: Column, pattern: str, group: int) -> Column:
    """A group of an anchored pattern in one pass; NULL when the text does not match."""
    return F.get(F.regexp_extract_all(url, F.lit(pattern), F.lit(group)), F.lit(0))


def _web_parts(url: Column) -> Column:
    """[scheme, userinfo@, host, port, path, ?query, #fragment] in one pass; NULL when not a web URL."""
    groups = _CUT.join(f"${i}" for i in range(1, 8))
    return let(F.split(F.regexp_replace(url, _WEB, groups), _CUT), lambda p: F.when(F.size(p) == 7, p))


def is_web_url(url: Column) -> Column:
    return url.rlike(_HOST)


def is_url(url: Column) -> Column:
    """An absolute URL of any scheme."""
    return url.rlike(_PATH)


def host_of(url: Column) -> Column:
    """Lower-case host, NULL when the URL is not valid or has none."""
    return F.lower(_match(url, _HOST, 1))


def path_of(url: Column) -> Column:
    """Path part, the opaque part for schemes other than web ones, NULL when not a URL."""
    return _match(url, _PATH, 1)


def _resolve_dots(path: Column) -> Column:
    """Remove `.` and `..` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.array_join(kept, "/"), tail), r"^/{0,1}", "/")


def _rebuilt(p: Column) -> Column:
    scheme, port, path = F.lower(p[0]), p[3], p[4]
    default_port = (
        (port == "")
        | (scheme.isin("http", "ws") & (port == "80"))
        | (scheme.isin("https", "wss") & (port == "443"))
        | ((scheme == "ftp") & (port == "21"))
    )
    return F.concat(
        scheme, F.lit("://"), p[1], F.lower(p[2]),
        F.when(default_port, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        _escaped(F.when(path == "", F.lit("/")).when(path.contains("/."), _resolve_dots(path)).otherwise(path), "\"<>`{}"),
        _escaped(p[5], "\"<>'"), _escaped(p[6], "\"<>`"),
    )


def _escaped(part: Column, marks: str) -> Column:
    """Blanks, characters outside of ASCII and the given marks as percent escapes. Hosts are left as they are."""
    unsafe = rf"[^!-~]|[{marks}]"
    each = F.transform(F.split(part, ""), lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(part.rlike(unsafe), F.array_join(each, "")).otherwise(part)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, default port dropped, empty path as `/`, dot segments resolved."""
    return F.when(url.rlike(_PLAIN), url).otherwise(F.coalesce(let(_web_parts(url), _rebuilt), url))


def _form_encode(text: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))
    return F.url_encode(decoded)


def _without_params(url: Column, names: list[str]) -> Column:
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    listed = F.array(*[F.lit(n) for n in names])

    def name_of(pair: Column) -> Column:
        raw = F.substring_index(pair, "=", 1)
        return F.coalesce(F.try_url_decode(raw), raw)

    kept = F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(listed, F.lower(name_of(p)))
    )
    pairs = F.transform(
        kept,
        lambda p: F.concat(
            _form_encode(F.substring_index(p, "=", 1)),
            F.lit("="),
            _form_encode(F.regexp_replace(p, r"^[^=]*=?", "")),
        ),
    )
    joined = F.regexp_replace(F.concat(F.lit("?"), F.array_join(pairs, "&")), r"^\?$", "")
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), joined, F.regexp_extract(url, r"(#.*)?$", 1))


def normalize_url(url: Column) -> Column:
    """Canonical URL without volatile parameters; text that is not a URL stays unchanged.

    Most URLs pass the first two tests and are copied. A query is written anew only when a volatile
    parameter leaves it.
    """
    names = "|".join(VOLATILE_PARAMS)
    may_hold = url.rlike(rf"(?i)[?&](?:{names}|[^=&#]*%[^=&#]*)(?:=|&|#|$)")

    def stripped(u: Column) -> Column:
        query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
        listed = F.array(*[F.lit(n) for n in VOLATILE_PARAMS])
        volatile = F.exists(F.split(query, "&"), lambda p: F.array_contains(
            listed, F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.lit("")))))
        return F.when(volatile, _without_params(u, VOLATILE_PARAMS)).otherwise(u)

    return (
        F.when(~may_hold, canonical_url(url))
        .when(is_web_url(url), let(stripped(url), canonical_url))
        .otherwise(url)
    )


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def dir_of(url: Column) -> Column:
    """The URL up to its last path slash; query and fragment are cut first."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(bare.contains("/"), F.regexp_replace(bare, r"[^/]*$", "")).otherwise(bare)


def ancestor_dirs(directory: Column) -> Column:
    """All directories a directory lies in, itself included, shortest first."""
    parts = F.split(directory, "/")
    return F.when(
        F.size(parts) >= 5,
        F.transform(
            F.sequence(F.lit(3), F.size(parts) - 1),
            lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")),
        ),
    ).otherwise(F.array(directory))


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def last_path_name(url: Column) -> Column:
    """Decoded last path part without its extension; NULL when the URL or its escapes are not valid."""
    name = _decoded(F.regexp_extract(path_of(url), r"([^/]*)$", 1))
    return F.regexp_replace(name, r"(?i)\.[a-z0-9]{1,5}$", "")


def title_from_url(url: Column) -> Column:
    """Name in the last path part (100 characters at most), else the host, else a fixed title."""
    named = let(last_path_name(url), lambda n: F.when(n != "", F.left(n, F.lit(100))).when(n == "", host_of(url)))
    return F.coalesce(named, F.lit(UNTITLED))


def ext_from_url(url: Column) -> Column:
    """Text after the last dot of the path, lower case."""
    return let(F.coalesce(path_of(url), without_query(url)), lambda path: F.lower(F.regexp_extract(path, r"([^.]*)$", 1)))


def base_parts(base: Column) -> Column:
    """What `resolve_against` needs of a base URL: computed once per base, however many URLs are resolved against it."""
    return let(base, lambda b: F.struct(
        bare_of(b, "#").alias("whole"), bare_of(b, "?#").alias("page"),
        F.concat(F.substring_index(b, ":", 1), F.lit(":")).alias("scheme"),
        F.regexp_replace(b, r"^([^:/?#]+://[^/?#]*).*$", "$1").alias("origin"),
        F.regexp_replace(b, r"^([^:/?#]+://[^/?#]*)(?:((?:/[^/?#]*)*)/[^/?#]*)?(?:[?#].*)?$", "$1$2/").alias("folder"),
        is_web_url(b).alias("web")))


def bare_of(url: Column, marks: str) -> Column:
    """The URL up to the first of the marks."""
    return F.regexp_replace(url, f"[{marks}].*$", "")


def resolve_against(parts: Column, rel: Column) -> Column:
    """X8 with the base as `base_parts`."""

    def resolved(r: Column) -> Column:
        joined = (
            F.when(r.rlike(_ANY_SCHEME), r)
            .when(r == "", parts["whole"])
            .when(r.startswith("//"), F.concat(parts["scheme"], r))
            .when(r.startswith("/"), F.concat(parts["origin"], r))
            .when(r.startswith("?"), F.concat(parts["page"], r))
            .when(r.startswith("#"), F.concat(parts["whole"], r))
            .otherwise(F.concat(parts["folder"], r))
        )
        return F.when(parts["web"] | r.rlike(_ANY_SCHEME), let(joined, canonical_url)).otherwise(r)

    return let(rel, resolved)


def resolve_url(base: Column, rel: Column) -> Column:
    """`rel` against `base`; absolute, scheme-relative, root-relative and relative forms."""
    return let(base_parts(base), lambda parts: resolve_against(parts, rel))


def sanitize_url(url: Column) -> Column:
    """Host and the first three path parts, the rest masked."""
    shown = let(path_of(url), lambda path: F.array_join(
        F.transform(F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, 3), lambda p: F.concat(p, F.lit("/"))), ""))
    masked = F.concat(F.coalesce(host_of(url), F.lit("")), F.lit("/"), shown, F.lit("***"))
    return F.coalesce(masked, F.lit("(invalid)"))


def sanitize_path(path: Column) -> Column:
    """Last folder or file name of a local path, the rest masked."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -1), F.lit("/**"))).otherwise(F.lit("/**"))


def credentials_note(present: Column) -> Column:
    """Whether credentials were attached, never the credentials themselves."""
    return F.when(present, F.lit("credentials")).otherwise(F.lit("no_credentials"))


# Fixed value: shape of a single-file track URL, `/dir/base-n-codec.ext` at the end of the path.
_TRACK = (
    r"(?i)^[a-z][a-z0-9+.\-]*+:(?://(?:[^/?#@\s]*+@)?([^/?#:\s]*+)(?::\d*+)?)?+(?:/[^/?#]*+)*?/([^/?#]+)/([^/?#]*?)-(\d+)-(\d+)\.(?:m4s|mp4|ts)(?:[?#].*)?$"
)
# its tail alone, which sorts out nearly all other URLs in one cheap pass
_TRACK_END = r"(?i)-\d+-\d+\.(?:m4s|mp4|ts)(?:[?#]|$)"


def is_track_url(url: Column) -> Column:
    """Whether `parse_track_url` would give a track."""
    return F.coalesce(url.rlike(_TRACK_END) & url.rlike(_TRACK), F.lit(False))


def parse_track_url(url: Column) -> Column:
    """A single-file track URL as a struct, NULL for any other URL."""

    def read(p: Column) -> Column:
        site, group, codec = F.lower(p[0]), F.concat(p[1], F.lit("/"), p[2]), p[3].try_cast("decimal(38,0)")
        digits = F.regexp_replace(p[3], r"^0+(?=\d)", "")
        key = F.concat(F.regexp_replace(site, r"^[^.]+\.", ""), F.lit("|"), group, F.lit("|"), digits)
        return F.when(F.size(p) == 4, F.struct(
            key.alias("key"), site.alias("site_key"), group.alias("group_id"), p[3].try_cast("bigint").alias("codec_id"),
            classify_track(codec).alias("track_type")))

    groups = _CUT.join(f"${i}" for i in (1, 2, 3, 5))
    return F.when(is_track_url(url), let(F.split(F.regexp_replace(url, _TRACK, groups), _CUT), read))


def classify_track(codec: Column) -> Column:
    """Codec numbers from 30000 below 100000 are audio."""
    return F.when((codec >= 30000) & (codec < 100000), F.lit("audio")).otherwise(F.lit("video"))
