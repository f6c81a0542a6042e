"""Hand-written examples for the column functions."""

import pytest
from pyspark.sql import functions as F

from mediatally.functions import media, text, urls

L = F.lit


@pytest.mark.parametrize("name", urls.VOLATILE_PARAMS)
def test_each_volatile_parameter_goes_and_its_neighbours_stay(value, name):
    for spelled in (name, name.upper(), name[0] + "%" + format(ord(name[1]), "02x") + name[2:]):
        got = value(urls.normalize_url(L(f"https://film.test/reel/7.webm?cut=2&{spelled}=zz9&my{name}=keep")))
        assert got == f"https://film.test/reel/7.webm?cut=2&my{name}=keep"
    assert value(urls.normalize_url(L(f"https://film.test/7.webm?{name}"))) == "https://film.test/7.webm"


@pytest.mark.parametrize("url,want", [
    ("WSS://Film.TEST:443/in/./side/../chat", "wss://film.test/in/chat"),
    ("http://film.test:443/x", "http://film.test:443/x"),
    ("ftp://film.test:21", "ftp://film.test/"),
    ("https://film.test/x/..", "https://film.test/"),
    ("https://film.test/../../up.mkv", "https://film.test/up.mkv"),
    ("https://film.test/p?sign=1&w=two%20words&bare#part=3", "https://film.test/p?w=two+words&bare=#part=3"),
    ("https://film.test/p?w=two%20words", "https://film.test/p?w=two%20words"),
    ("https://film.test/p?share=50%", "https://film.test/p?share=50%"),
    ("reel seven", "reel seven"),
    ("blob:https://film.test/5f-1e", "blob:https://film.test/5f-1e"),
])
def test_normalize_url(value, url, want):
    assert value(urls.normalize_url(L(url))) == want


def test_dir_and_ancestors(value):
    assert value(urls.dir_of(L("https://film.test/s/t/u.mkv?back=/q/r#/z"))) == "https://film.test/s/t/"
    assert value(urls.ancestor_dirs(L("https://film.test/s/t/"))) == ["https://film.test/", "https://film.test/s/", "https://film.test/s/t/"]
    assert value(urls.ancestor_dirs(L("https://film.test/"))) == ["https://film.test/"]


@pytest.mark.parametrize("url,want", [
    ("https://film.test/box/Two%20Reels.ogg#t=4", "Two Reels"), ("https://film.test/", "film.test"), ("https://film.test/%C3%A4iti.mpd", "äiti"),
    ("no address", "未命名媒体"), ("https://film.test/broken%4.mkv", "未命名媒体"), ("https://film.test/" + "ab" * 70 + ".mkv", "ab" * 50),
    ("https://film.test/archive.tar.mkv", "archive.tar"), ("https://film.test/noext", "noext"),
])
def test_title_from_url(value, url, want):
    assert value(urls.title_from_url(L(url))) == want


HERE = "https://film.test/shelf/box/list.mpd?from=/a/b#top"


@pytest.mark.parametrize("base,rel,want", [
    (HERE, "reel/1.bin", "https://film.test/shelf/box/reel/1.bin"),
    (HERE, "./1.bin", "https://film.test/shelf/box/1.bin"),
    (HERE, "../../../1.bin", "https://film.test/1.bin"),
    (HERE, "/1.bin", "https://film.test/1.bin"),
    (HERE, "//Store.test/1.bin", "https://store.test/1.bin"),
    (HERE, "HTTP://Store.test:80/1.bin", "http://store.test/1.bin"),
    (HERE, "", "https://film.test/shelf/box/list.mpd?from=/a/b"),
    (HERE, "?k=2", "https://film.test/shelf/box/list.mpd?k=2"),
    (HERE, "#end", "https://film.test/shelf/box/list.mpd?from=/a/b#end"),
    ("https://film.test", "1.bin", "https://film.test/1.bin"),
    ("shelf", "1.bin", "1.bin"),
    ("shelf", "https://film.test/1.bin", "https://film.test/1.bin"),
])
def test_resolve_url(value, base, rel, want):
    assert value(urls.resolve_url(L(base), L(rel))) == want
    assert value(urls.resolve_against(urls.base_parts(L(base)), L(rel))) == want


@pytest.mark.parametrize("codec,kind", [(0, "video"), (29999, "video"), (30000, "audio"), (99999, "audio"), (100000, "video")])
@pytest.mark.parametrize("ext", ["m4s", "MP4", "ts"])
def test_track_urls(value, codec, kind, ext):
    for host, site in (("n3.media.test:8443", "n3.media.test"), ("N4.Media.test", "n4.media.test")):
        track = value(urls.parse_track_url(L(f"https://{host}/deep/er/lot-5/piece_k-2-{codec}.{ext}?sig=1#x")))
        assert tuple(track) == (f"media.test|lot-5/piece_k|{codec}", site, "lot-5/piece_k", codec, kind)


@pytest.mark.parametrize("url", ["https://media.test/piece-2.m4s", "https://media.test/lot/piece-2-x.m4s", "https://media.test/lot/piece-2-7.mkv", "https://media.test/piece-2-7.m4s",
                                 "lot/piece-2-7.m4s", "https://media.test/lot/?piece-2-7.m4s"])
def test_other_urls_are_no_tracks(value, url):
    assert value(urls.parse_track_url(L(url))) is None
    assert value(urls.is_track_url(L(url))) is False


def test_host_ext_and_masks(value):
    assert value(urls.host_of(L("https://u:p@A.com:8080/x"))) == "a.com"
    assert value(urls.host_of(L("x"))) is None
    assert value(urls.ext_from_url(L("https://a/b/C400.m4a?vkey=ABC&u=1"))) == "m4a"
    assert value(urls.ext_from_url(L("https://a/b/MOV.MP4"))) == "mp4"
    assert value(urls.sanitize_url(L("https://c.com/a/b/c/d.ts?token=1"))) == "c.com/a/b/c/***"
    assert value(urls.sanitize_url(L("https://c.com"))) == "c.com/***"
    assert value(urls.sanitize_url(L("?"))) == "(invalid)"
    assert value(urls.sanitize_path(L("/home/u/file.mp4"))) == "file.mp4/**"
    assert value(urls.sanitize_path(L("/file"))) == "/**"
    assert value(urls.credentials_note(L(True))) == "credentials"


@pytest.mark.parametrize("size,want", [
    (311 * 1024 * 1024, "311 MB"), (3.7 * 1024 ** 3, "3.7 GB"), (2.6 * 1024 ** 2, "2.6 MB"), (77, "77 B"), (None, "unknown"), (-1, "unknown"),
    (1024, "1.0 KB"), (99.96 * 1024, "100.0 KB"), (5 * 1024 ** 5, "5120 TB"),
])
def test_format_bytes(value, size, want):
    assert value(text.format_bytes(L(size).cast("double"))) == want


@pytest.mark.parametrize("sec,want", [(7384, "02:03:04"), (61, "00:01:01"), (0, "--:--"), (None, "--:--"), (-5, "--:--"), (360000, "100:00:00"), (59.5, "00:01:00")])
def test_format_duration(value, sec, want):
    assert value(text.format_duration(L(sec).cast("double"))) == want


def test_hash(value):
    assert value(text.hash_key(L("https://c.com/v.mp4"))) == "5d9f5224"
    assert value(text.hash_key(L(""))) == "811c9dc5"
    h = 2166136261
    for c in "1:nolist:a/b":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    assert int(value(text.hash_key36(L("1:nolist:a/b"))), 36) == h


def test_resolution(value):
    assert value(media.resolution_of(L("1920x1080"))["label"]) == "1080p"
    assert value(media.resolution_of(L("1280x720"))["pixels"]) == 1280 * 720
    assert value(media.resolution_of(L(None).cast("string"))["label"]) == ""
    assert value(media.resolution_of(L("320x200"))["label"]) == "low"
    assert value(media.quality_label_dash(L("640x360"))) == "360p"


META = dict(title="Kuusi ja tähti", site="tube.test", resolution="1440x1080", quality="1080p", bitrate=731.0, duration_sec=7384.0,
            date="19991231", time="235958", index=8, ext="mkv")
SHOWN = dict(title="Kuusi ja tähti", site="tube.test", resolution="1440x1080", quality="1080p", bitrate="731kbps", duration="02h03m04s",
             date="19991231", time="235958", index="08")  # an extension is never part of the name itself


@pytest.fixture
def named(value):
    """A file name from a template and changes to META."""
    types = {"bitrate": "double", "duration_sec": "double", "index": "bigint"}

    def run(template, **change):
        return value(text.build_filename(template, {k: L(v).cast(types.get(k, "string")) for k, v in {**META, **change}.items()}))

    return run


@pytest.mark.parametrize("name", text.TEMPLATE_VARS)
def test_every_variable_fills_its_place_or_leaves_no_gap(named, name):
    assert named(f"pre_{{{name}}}_post") == (f"pre_{SHOWN[name]}_post.mkv" if name in SHOWN else "pre-post.mkv")
    if name not in ("title", "ext"):
        gone = "duration_sec" if name == "duration" else name
        assert named(f"{{title}}-{{{name}}}-end", **{gone: None}) == "Kuusi ja tähti-end.mkv"
        assert named(f"{{{name}}}", **{gone: None}).startswith("Kuusi ja tähti")


def test_file_names_that_come_out_empty(named):
    assert named("{site}", site=None) == "Kuusi ja tähti.mkv"
    assert named("{site}", site=None, title=None) == "未命名媒体.mkv"
    assert named("{title}", title=" ") == "未命名媒体.mkv"


def test_file_names_keep_unknown_places_and_texts_that_look_like_places(named):
    assert named("{title} {colour}") == "Kuusi ja tähti {colour}.mkv"
    assert named("{title}", title="use {date} here") == "use {date} here.mkv"


@pytest.mark.parametrize("mark", list('/\\:*?"<>|') + ["\x01", "\x1f"])
def test_no_file_name_holds_a_forbidden_mark(named, mark):
    assert named("{title}", title=f"left{mark}right") == "leftright.mkv"


@pytest.mark.parametrize("n", [149, 150, 151, 400])
def test_file_names_end_at_their_limit(named, n):
    assert named("{title}", title="ä" * n) == "ä" * min(n, text.MAX_NAME) + ".mkv"


@pytest.mark.parametrize("ext", ["mkv", "webm", "m4a"])
def test_an_extension_in_the_template_gives_way(named, ext):
    assert named("{title}." + ext, ext="webm") == "Kuusi ja tähti.webm"


@pytest.mark.parametrize("template,reason", [
    ("{title}" + "b" * 193, None), ("{title}" + "b" * 194, "too_long"), ("b{index}", None), ("{Title}", "not_unique"), ("{date}_{time}", "not_unique"),
    ("\t \u3000", "empty"), (None, "empty")])
def test_validate_template(value, template, reason):
    assert tuple(value(text.validate_template(L(template).cast("string")))) == (reason is None, reason)


PROFILE = [
    ("audio", "https://radio.test/take.m4a?v=2", "progressive", None, "original", ("audio", "m4a", "m4a", "audio/mp4")),
    ("audio", "https://radio.test/take.mp3#x", "progressive", None, "original", ("audio", "mp3", "mp3", "audio/mpeg")),
    ("audio", "https://radio.test/play", "progressive", "audio/mpeg", "original", ("audio", "mp3", "mp3", "audio/mpeg")),
    ("audio", "https://radio.test/notes.doc", "progressive", "audio/mp4", "original", ("audio", "m4a", "m4a", "audio/mp4")),
    ("video", "https://radio.test/long.flac?a=1", "progressive", None, "original", ("audio", "flac", "flac", "audio/flac")),
    ("audio", "https://radio.test/b/c.m4a", "progressive", None, "mp3", ("audio", "mp3", "mp3", "audio/mpeg")),
    ("video", "https://film.test/all.m3u8", "hls", None, "mp3", ("video", "mp4", "mp4", "video/mp4")),
    ("video", "https://film.test/x/y.webm", "progressive", None, "original", ("video", "mp4", "webm", "video/mp4")),
    ("video", "https://film.test/still.png", "progressive", None, "original", ("video", "mp4", "mp4", "video/mp4")),
    ("video", "https://film.test/9.m4s", "progressive", None, "original", ("video", "mp4", "m4s", "video/mp4")),
]


@pytest.mark.parametrize("kind,url,protocol,mime,pref,want", PROFILE)
def test_output_profile(value, kind, url, protocol, mime, pref, want):
    assert tuple(value(media.output_profile(L(kind), L(protocol), L(url), L(mime).cast("string"), pref))) == want


def test_iso_duration_and_templates(value):
    assert value(text.parse_iso_duration(L("PT3H1M7S"))) == 10867
    assert value(text.parse_iso_duration(L("P0DT0H30M10.5S"))) == 1810.5
    assert value(text.parse_iso_duration(L("1h"))) is None
    ids = dict(representation_id=L("v1"), bandwidth=L(9))
    assert value(text.substitute_template(L("r$RepresentationID$_$Number%02d$"), number=L(7), **ids)) == "rv1_07"
    assert value(text.substitute_template(L("$Number%02d$-$Number$-$Bandwidth$"), number=L(1234), **ids)) == "1234-1234-9"
    assert value(text.substitute_template(L("at$Time$.bin"), number=L(1), **ids)) == "at.bin"
    assert value(text.substitute_template(L("$Number%03d$/$Number%05d$/$$x$"), number=L(7), **ids)) == "007/00007/$$x$"
    assert value(text.substitute_template(L("$RepresentationID%04d$-$Bandwidth%03d$"), number=L(7), **ids)) == "00v1-009"


def test_icons(value):
    icon = lambda n, d, b, p, a: tuple(value(media.session_status(*[L(x) for x in (n, d, b, p, a)])))
    assert icon(0, 0, 0, 0, 0) == ("gray", None)
    assert icon(1, 0, 0, 1, 0) == ("idle", None)
    assert icon(12, 12, 0, 0, 0) == ("idle", "9+")
    assert icon(3, 3, 0, 0, 0) == ("idle", "3")
    assert icon(1, 0, 1, 0, 1) == ("locked", None)
    assert icon(1, 1, 0, 0, 1) == ("ring", "1")


def test_memory(value):
    assert value(media.merge_feasible(L(1.6 * 1024), L(16)))["ok"] is True
    r = value(media.merge_feasible(L(2.0 * 1024), L(8)))
    assert (r.ok, r.watermark_mb) == (False, 2048.0)
    assert value(media.merge_feasible(L(1000.0)))["peak_mb"] == pytest.approx(1600)


def test_brand_and_format(value):
    head = bytes([0, 0, 0, 16]) + b"ftypmp42" + bytes(4)
    assert tuple(value(media.ftyp_brand(L(head)))) == (True, "mp42", "video")
    assert value(media.ftyp_brand(L(bytes([0, 0, 0, 16]) + b"ftypM4A " + bytes(4))))["family"] == "audio"
    assert value(media.ftyp_brand(L(b"\x47" * 20)))["is_mp4"] is False
    none = L(None).cast("string")
    assert value(media.input_format(none, L(b"\x47\x00"))) == "ts"
    assert value(media.input_format(none, L(b"\x00"))) == "fmp4"
    assert value(media.input_format(L("https://c/a.m4s"), L(b"\x47"))) == "fmp4"


def test_iv(value):
    assert value(text.aes_iv(L(None).cast("string"), L(258))).hex() == "0" * 29 + "102"
    assert value(text.aes_iv(L("0123456789abcdef0f1e2d3c4b5a6978"), L(1))).hex() == "0123456789abcdef0f1e2d3c4b5a6978"


def test_classify(value):
    kind = lambda u, m=None: value(media.classify_hint(L(u), L(m).cast("string")))
    assert kind("blob:https://x/1") == "blob"
    assert kind("https://x/a.M3U8?x") == "manifest"
    assert kind("https://x/a", "application/dash+xml") == "manifest"
    assert kind("https://x/a", "video/mp2t") == "segment"
    assert kind("https://x/a.ts") == "segment"
    assert kind("https://x/a.ts.html", None) == "progressive"
    looks = lambda u, m=None, r=False: value(media.looks_like_media(L(u), L(m).cast("string"), L(r)))
    assert looks("https://x/a.mp4") and looks("https://x/a", "Video/x") and looks("https://x/a", None, True)
    assert not looks("https://x/a.jpg", "image/jpeg")


def test_titles(value):
    got = value(text.derive_title(L("My: Show - 高清在线观看"), L("https://c/x.mp4"), L(0)))
    assert got == "My Show"
    assert value(text.derive_title(L(""), L("https://c.com/a/b-1.mp4"), L(0))) == "b-1"
    assert value(text.derive_title(L(None).cast("string"), L("https://c.com/"), L(1704067200000))) == "c.com-2024-01-01"
    assert value(text.clean_title(L("  a　b\n/c  "))) == "a bc"


def test_urls_are_escaped(value):
    norm = lambda u: value(urls.normalize_url(L(u)))
    assert norm("https://Film.test/a b/ä你.mp4?q=x y&z=\"<é#f g") == "https://film.test/a%20b/%C3%A4%E4%BD%A0.mp4?q=x%20y&z=%22%3C%C3%A9#f%20g"
    assert norm("https://film.test/a%20b") == "https://film.test/a%20b"
    assert norm("https://film.test/{x}?y={z}") == "https://film.test/%7Bx%7D?y={z}"


def test_tracks_with_long_numbers(value):
    track = value(urls.parse_track_url(L("https://a.film.test/d/base-1-1234567890123456789012.m4s")))
    assert (track.codec_id, track.track_type, track.key) == (None, "video", "film.test|d/base|1234567890123456789012")
    track = value(urls.parse_track_url(L("https://a.film.test/d/base-1-0030123.m4s")))
    assert (track.codec_id, track.track_type, track.key) == (30123, "audio", "film.test|d/base|30123")
