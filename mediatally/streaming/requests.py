"""Streams over request logs: dedup, page loads, item merging, track groups, waiting segments and audio."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mediatally.functions import media, text, urls
from mediatally.operators.dedup import WINDOW_MS
from mediatally.operators.items import upsert_items
from mediatally.operators.scan import HOUR_MS
from mediatally.streaming.ordered import BUCKETS, InOrder, in_buckets, in_order

QUIET_MS = 1200
WAIT_MS = 12_000


def with_event_time(stream: DataFrame, watermark: str) -> DataFrame:
    """Event time from `ts_ms`; rows behind the watermark are dropped and show in numRowsDroppedByWatermark."""
    return stream.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", watermark)


def _placed(stream: DataFrame, watermark: str) -> DataFrame:
    """Rows that have a tab and a place in event time; no other row can be ordered."""
    return with_event_time(stream.filter("tab_id IS NOT NULL AND ts_ms IS NOT NULL AND request_id IS NOT NULL"), watermark)


def closed_window_counts(stream: DataFrame, *, span: str = "10 seconds", watermark: str = "30 seconds") -> DataFrame:
    """Requests per tab and window. A window is put out once, when the watermark has passed its end;
    later rows of that window are dropped and counted."""
    windows = with_event_time(stream, watermark).groupBy("tab_id", F.window("event_time", span).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("requests")).select("tab_id", F.unix_millis("w.start").alias("window_ms"), "requests")


class _Dedup(InOrder):
    """Remembers the last kept time of every key of the bucket, as long as it can still keep a later row out."""

    def __init__(self, window_ms: int, columns: list[str]):
        super().__init__(["ts_ms", "request_id"], [*columns, "url_base"], columns)
        self.window_ms = window_ms

    def decide(self, rows, upto, memory):
        held = memory.get("last")
        last = {} if held is None else dict(zip(zip(held["tab_id"], held["url_base"]), held["ts_ms"]))
        keep = []
        for i, (tab, base, ts) in enumerate(zip(rows["tab_id"], rows["url_base"], rows["ts_ms"])):
            before = last.get((tab, base))
            if before is None or ts - before >= self.window_ms:
                last[tab, base] = ts
                keep.append(i)
        out = list(rows.iloc[keep][self.output].itertuples(index=False, name=None))
        live = [(tab, base, ts) for (tab, base), ts in last.items() if ts + self.window_ms > upto]
        return out, {"last": pd.DataFrame(live, columns=["tab_id", "url_base", "ts_ms"])} if live else {}

    def next_time(self, memory):
        # to forget the keys when nothing follows
        return int(memory["last"]["ts_ms"].max()) + self.window_ms if memory else None


def stream_dedup_60s(stream: DataFrame, *, watermark: str = "10 minutes", window_ms: int = WINDOW_MS, buckets: int = BUCKETS) -> DataFrame:
    """R1, exact: the greedy 60 s rule per tab and URL without query, in event order, however the rows arrive.

    A row is put out when the watermark has passed it. Rows of one bucket of keys share a state entry; `buckets` is at
    least the number of cores and stays the same as long as the checkpoint lives. Rows without a tab, time or number are left out.
    """
    columns = ["request_id", "tab_id", "ts_ms", "url"]
    keyed = _placed(stream.select(*columns), watermark).withColumn("url_base", urls.without_query(F.col("url")))
    schema = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in columns)
    dealt = in_buckets(keyed, [F.col("tab_id"), F.col("url_base")], buckets=buckets)
    return in_order(dealt, _Dedup(window_ms, columns), schema)


def stream_dedup_approximate(stream: DataFrame, *, watermark: str = "60 seconds") -> DataFrame:
    """R1, approximate: one row per key within the watermark delay, which runs by the stream's clock and not from the kept row."""
    keyed = with_event_time(stream, watermark).withColumn("url_base", urls.without_query(F.col("url")))
    return keyed.dropDuplicatesWithinWatermark(["tab_id", "url_base"]).drop("event_time", "url_base")


def _of(memory: dict[str, pd.DataFrame], name: str) -> list[tuple]:
    held = memory.get(name)
    return [] if held is None else list(held.itertuples(index=False, name=None))


class _PageItems(InOrder):
    """Page loads counted and items seen on the page a tab shows, for every tab and shard of the bucket."""

    def __init__(self):
        super().__init__(["ts_ms", "request_id"], ["tab_id", "shard", "kind", "dedup_key", "ts_ms", "request_id"],
                         ["tab_id", "epoch", "dedup_key", "detected_ms"])

    def decide(self, rows, upto, memory):
        loads = {(tab, shard): n for tab, shard, n in _of(memory, "loads")}
        seen: dict[tuple, set] = {}
        for tab, shard, key in _of(memory, "seen"):
            seen.setdefault((tab, shard), set()).add(key)
        out = []
        for tab, shard, kind, key, ts in zip(*(rows[c] for c in ("tab_id", "shard", "kind", "dedup_key", "ts_ms"))):
            at = (tab, shard)
            if kind == "nav":
                loads[at] = loads.get(at, 0) + 1
                seen.pop(at, None)
            elif key not in seen.setdefault(at, set()):
                seen[at].add(key)
                out.append((tab, loads.get(at, 0), key, ts))
        after = {"loads": pd.DataFrame([(*at, n) for at, n in loads.items()], columns=["tab_id", "shard", "n"]),
                 "seen": pd.DataFrame([(*at, k) for at, keys in seen.items() for k in keys], columns=["tab_id", "shard", "key"])}
        return out, {name: pdf for name, pdf in after.items() if len(pdf)}


def stream_navigation_reset(stream: DataFrame, *, watermark: str = "10 minutes", buckets: int = BUCKETS, shards: int = 16) -> DataFrame:
    """R4, exact: first sighting of each URL per tab and page load, in event order; a `nav` row clears the tab's state.

    A tab's URLs are spread over `shards` state entries that all see its page loads, so one busy tab is not one task.
    State is the pages that tabs show: it ends with the next page load.
    """
    df = _placed(stream, watermark).select(
        "tab_id", "request_id", "ts_ms", "kind", urls.normalize_url(F.col("url")).alias("dedup_key"), "event_time")
    dealt = in_buckets(df, [F.col("tab_id")], buckets=buckets, shards=shards, part=F.col("dedup_key"), everywhere=F.col("kind") == "nav")
    return in_order(dealt, _PageItems(), "tab_id bigint, epoch bigint, dedup_key string, detected_ms bigint")


class _TrackGroups(InOrder):
    """Best tracks per group of a tab; a group is put out when it has not changed for the quiet time."""

    def __init__(self, quiet_ms: int):
        super().__init__(["ts_ms", "request_id"], ["tab_id", "shard", "kind", "group_id", "codec_id", "track_type", "ts_ms", "request_id"],
                         ["tab_id", "group_id", "video_codec", "audio_codec", "ready_ms"])
        self.quiet_ms = quiet_ms

    def decide(self, rows, upto, memory):
        # per tab and shard its groups: best video, best audio, and when the group is due (None: put out already); -1 is no codec
        tabs: dict[tuple, dict] = {}
        for tab, shard, group, video, audio, due in _of(memory, "groups"):
            tabs.setdefault((tab, shard), {})[group] = [video, audio, None if due < 0 else due]
        out: list[tuple] = []

        def ready(tab, groups, now):
            for group, state in groups.items():
                video, audio, due = state
                if due is not None and due <= now:
                    state[2] = None
                    if video >= 0:
                        out.append((tab, group, video, audio if audio >= 0 else None, due))

        for tab, shard, kind, group, codec, track, ts in zip(
                *(rows[c] for c in ("tab_id", "shard", "kind", "group_id", "codec_id", "track_type", "ts_ms"))):
            groups = tabs.setdefault((tab, shard), {})
            if kind == "nav":
                ready(tab, groups, ts)
                groups.clear()
                continue
            if group in groups:
                ready(tab, {group: groups[group]}, ts)
            state = groups.setdefault(group, [-1, -1, None])
            side = 0 if track == "video" else 1
            if codec > state[side]:
                state[side], state[2] = codec, ts + self.quiet_ms
        for (tab, _), groups in tabs.items():
            ready(tab, groups, upto)
        held = [(*at, g, v, a, -1 if due is None else due) for at, groups in tabs.items() for g, (v, a, due) in groups.items()]
        return out, {"groups": pd.DataFrame(held, columns=["tab_id", "shard", "group_id", "video", "audio", "due"])} if held else {}

    def next_time(self, memory):
        due = memory["groups"]["due"] if memory else pd.Series([], dtype="int64")
        return int(due[due >= 0].min()) if (due >= 0).any() else None


def stream_track_groups(stream: DataFrame, *, watermark: str = "10 minutes", quiet_ms: int = QUIET_MS, buckets: int = BUCKETS,
                        shards: int = 4) -> DataFrame:
    """R2, exact: a group's best tracks 1200 ms of event time after its last change, again after each later
    improvement, in event order; page loads clear a tab. Only track requests and page loads reach the state, and a tab's
    groups are spread over `shards` state entries."""
    df = _placed(stream, watermark).withColumn("_t", F.when(urls.is_track_url(F.col("url")), urls.parse_track_url(F.col("url"))))
    df = df.filter((F.col("kind") == "nav") | F.col("_t").isNotNull()).select(
        "tab_id", "request_id", "ts_ms", "kind", F.coalesce("_t.group_id", F.lit("")).alias("group_id"),
        F.coalesce("_t.codec_id", F.lit(0)).alias("codec_id"), F.coalesce("_t.track_type", F.lit("")).alias("track_type"), "event_time")
    dealt = in_buckets(df, [F.col("tab_id")], buckets=buckets, shards=shards, part=F.col("group_id"), everywhere=F.col("kind") == "nav")
    return in_order(dealt, _TrackGroups(quiet_ms),
                    "tab_id bigint, group_id string, video_codec bigint, audio_codec bigint, ready_ms bigint")


def stream_track_groups_by_session(stream: DataFrame, *, watermark: str = "10 minutes", quiet_ms: int = QUIET_MS) -> DataFrame:
    """R2, approximate: best tracks per session of requests; any request keeps a session open, not only a change."""
    df = with_event_time(stream, watermark).withColumn("_t", urls.parse_track_url(F.col("url"))).filter("_t IS NOT NULL")
    codec = F.col("_t.codec_id")
    kind = F.col("_t.track_type")
    return (
        df.groupBy("tab_id", F.col("_t.group_id").alias("group_id"), F.session_window("event_time", f"{quiet_ms} milliseconds").alias("w"))
        .agg(F.max(F.when(kind == "video", codec)).alias("video_codec"), F.max(F.when(kind == "audio", codec)).alias("audio_codec"))
        .filter("video_codec IS NOT NULL").select("tab_id", "group_id", "video_codec", "audio_codec", F.unix_millis("w.end").alias("ready_ms")))


def stream_items(stream: DataFrame, *, watermark: str = "10 minutes") -> DataFrame:
    """Running items per tab and URL, in update mode; partial aggregation runs before the shuffle."""
    df = with_event_time(stream, watermark).withColumn("dedup_key", urls.normalize_url(F.col("url")))
    first = F.struct("ts_ms", "request_id")
    return df.groupBy("tab_id", "dedup_key").agg(
        F.min("ts_ms").alias("detected_ms"), F.max("ts_ms").alias("updated_ms"), F.count(F.lit(1)).alias("hint_count"),
        F.min_by("size", F.when(F.col("size") > 0, first)).alias("size_estimate"))


def current_items(updates: DataFrame) -> DataFrame:
    """The latest update of every item."""
    latest = upsert_items(updates, keys=["tab_id", "dedup_key"], order=["batch_id"], first="detected_ms")
    return latest.drop("batch_id")


class _LiveStates(InOrder):
    """First and latest save and number of saves of each tab's state."""

    def __init__(self, ttl_ms: int):
        super().__init__(["ts_ms"], ["tab_id", "ts_ms"], ["tab_id", "first_saved_ms", "saved_ms", "saves", "expired_ms"])
        self.ttl_ms = ttl_ms

    def decide(self, rows, upto, memory):
        live = {tab: (first, last, n) for tab, first, last, n in _of(memory, "states")}
        out = []
        for tab, ts in zip(rows["tab_id"], rows["ts_ms"]):
            first, last, n = live.get(tab, (ts, ts, 0))
            if ts - last > self.ttl_ms:
                out.append((tab, first, last, n, last + self.ttl_ms))
                first, n = ts, 0
            live[tab] = (first, ts, n + 1)
        for tab, (first, last, n) in list(live.items()):
            if last + self.ttl_ms <= upto:  # every later save is younger than that
                out.append((tab, first, last, n, last + self.ttl_ms))
                del live[tab]
        return out, {"states": pd.DataFrame([(t, *s) for t, s in live.items()], columns=["tab_id", "first", "last", "n"])} if live else {}

    def next_time(self, memory):
        return int(memory["states"]["last"].min()) + self.ttl_ms if memory else None


def stream_live_states(saves: DataFrame, *, ttl_ms: int = 12 * HOUR_MS, watermark: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The states of tabs and when they expired. A save keeps its tab's state for another twelve hours of event time; a
    later one begins a new state. A state is put out when its time is over, in event order.

    `saves`: tab_id and saved_ms. Rows without either are left out.
    """
    timed = saves.filter("tab_id IS NOT NULL AND saved_ms IS NOT NULL").select("tab_id", F.col("saved_ms").alias("ts_ms"))
    dealt = in_buckets(with_event_time(timed, watermark), [F.col("tab_id")], buckets=buckets)
    return in_order(dealt, _LiveStates(ttl_ms), "tab_id bigint, first_saved_ms bigint, saved_ms bigint, saves bigint, expired_ms bigint")


def _ancestors(directory: str) -> list[str]:
    """As `urls.ancestor_dirs`."""
    parts = directory.split("/")
    return ["/".join(parts[:n]) + "/" for n in range(3, len(parts))] if len(parts) >= 5 else [directory]


class _FirstManifests(InOrder):
    """Per tab and shard (of origins): page loads, the first manifest of every directory, and segments that wait."""

    def __init__(self):
        super().__init__(["ts_ms", "request_id"], ["tab_id", "shard", "kind", "dir", "dedup_key", "ts_ms", "request_id"],
                         ["tab_id", "epoch", "dir", "dedup_key", "segment_count"])

    def decide(self, rows, upto, memory):
        loads = {(tab, shard): n for tab, shard, n in _of(memory, "loads")}
        # at: directory -> (number, key) of its first manifest; below: the first one in it or deeper
        at, below, waiting = ({}, {}, {})

        def place(where, mdir, number, key):
            if mdir not in at.setdefault(where, {}):
                at[where][mdir] = (number, key)
                for a in _ancestors(mdir):
                    below.setdefault(where, {}).setdefault(a, (number, key))

        for tab, shard, mdir, number, key in _of(memory, "manifests"):
            place((tab, shard), mdir, number, key)
        for tab, shard, folder, n in _of(memory, "waiting"):
            waiting.setdefault((tab, shard), {})[folder] = n
        counts: Counter = Counter()
        for tab, shard, kind, folder, key in zip(*(rows[c] for c in ("tab_id", "shard", "kind", "dir", "dedup_key"))):
            where = (tab, shard)
            epoch = loads.get(where, 0)
            if kind == "nav":
                for left, n in waiting.pop(where, {}).items():
                    counts[tab, epoch, left, None] += n
                at.pop(where, None), below.pop(where, None)
                loads[where] = epoch + 1
            elif kind == "manifest":
                if folder in at.get(where, {}):
                    continue
                place(where, folder, len(at.get(where, {})), key)
                held = waiting.get(where, {})
                for d in [d for d in held if d.startswith(folder) or folder.startswith(d)]:
                    counts[tab, epoch, d, key] += held.pop(d)
            else:
                found = [at[where][a] for a in _ancestors(folder) if a in at[where]] if where in at else []
                if folder in below.get(where, {}):
                    found.append(below[where][folder])
                if found:
                    counts[tab, epoch, folder, min(found)[1]] += 1
                else:
                    waiting.setdefault(where, {})[folder] = waiting.get(where, {}).get(folder, 0) + 1
        after = {
            "loads": pd.DataFrame([(*w, n) for w, n in loads.items()], columns=["tab_id", "shard", "n"]),
            "manifests": pd.DataFrame([(*w, d, n, k) for w, dirs in at.items() for d, (n, k) in dirs.items()],
                                      columns=["tab_id", "shard", "dir", "number", "key"]),
            "waiting": pd.DataFrame([(*w, d, n) for w, dirs in waiting.items() for d, n in dirs.items()], columns=["tab_id", "shard", "dir", "n"])}
        return [(*k, n) for k, n in counts.items()], {name: pdf for name, pdf in after.items() if len(pdf)}


def stream_first_manifests(hints: DataFrame, *, watermark: str = "10 minutes", buckets: int = BUCKETS, shards: int = 16) -> DataFrame:
    """R6, exact: segments with the first manifest of their page whose directory contains, or lies in, theirs, whichever
    comes first. A segment without one waits; when the page is left it is put out with a NULL manifest.

    `hints`: tab_id, request_id, ts_ms, kind (`nav` or anything else), url and mime. Rows of the result are counts to be added up per
    tab, epoch, dir and dedup_key. Directories that contain one another have one origin, so a tab's hints are
    spread by origin over `shards` state entries, which all see its page loads. State ends with the page.
    """
    key = urls.normalize_url(F.col("url"))
    kind = F.when(F.col("kind") == "nav", F.lit("nav")).otherwise(media.classify_hint(F.col("url"), F.col("mime")))
    df = _placed(hints, watermark).select("tab_id", "request_id", "ts_ms", kind.alias("kind"), key.alias("dedup_key"), "event_time")
    df = df.filter(F.col("kind").isin("nav", "segment", "manifest")).withColumn("dir", urls.dir_of(F.col("dedup_key")))
    origin = F.substring_index(F.col("dir"), "/", 3)
    dealt = in_buckets(df, [F.col("tab_id")], buckets=buckets, shards=shards, part=origin, everywhere=F.col("kind") == "nav")
    return in_order(dealt, _FirstManifests(), "tab_id bigint, epoch bigint, dir string, dedup_key string, segment_count bigint")


def stream_pending_segments(segments: DataFrame, manifests: DataFrame, *, watermark: str = "10 minutes",
                            wait: str = "10 minutes") -> DataFrame:
    """Segments with the manifests at an ancestor directory that appear within `wait` of them, before or after.

    Each side keeps the first and last time of a directory or manifest per slot of the length of `wait`. Two that lie in one
    slot are near; in neighbouring slots the last time of the earlier and the first of the later one decide; others are
    too far apart. So no repeat is lost, a busy directory meets each manifest once per slot, and a slot's rows are put out when
    the watermark has passed its end. A pair that goes on meeting comes again with every slot.
    """
    def slots(df: DataFrame, side: str, keys: dict) -> DataFrame:
        df = df.select(*[c.alias(k) for k, c in keys.items()], F.timestamp_millis("ts_ms").alias("_at")).withWatermark("_at", watermark)
        seen = df.groupBy(*keys, F.window("_at", wait).alias("w")).agg(F.min("_at").alias(f"{side}_first"), F.max("_at").alias(f"{side}_last"))
        return seen.select(*keys, f"{side}_first", f"{side}_last", F.window_time("w").alias(f"{side}_time"))

    s = slots(segments, "s", {"tab_id": F.col("tab_id"), "dir": urls.dir_of(urls.normalize_url(F.col("url")))})
    # the explodes hold the join's tests for NULL above the counts, where there are few rows
    s = s.withColumn("anc", F.explode_outer(urls.ancestor_dirs(F.col("dir"))))
    m = slots(manifests, "m", {"m_tab": F.col("tab_id"), "dedup_key": urls.normalize_url(F.col("url"))})
    m = m.withColumn("m_dir", F.explode_outer(F.array(urls.dir_of(F.col("dedup_key")))))
    near = F.expr(f"m_time BETWEEN s_time - INTERVAL {wait} AND s_time + INTERVAL {wait} "
                  f"AND m_first <= s_last + INTERVAL {wait} AND s_first <= m_last + INTERVAL {wait}")
    joined = s.join(m, (F.col("tab_id") == F.col("m_tab")) & (F.col("anc") == F.col("m_dir")) & near)
    segment = F.when(F.col("m_time") > F.col("s_time"), F.col("s_last")).otherwise(F.col("s_first"))
    manifest = F.when(F.col("m_time") < F.col("s_time"), F.col("m_last")).otherwise(F.col("m_first"))
    return joined.select("tab_id", "dir", "dedup_key", F.unix_millis(segment).alias("segment_ms"), F.unix_millis(manifest).alias("manifest_ms"))


def stream_await_audio(video: DataFrame, audio: DataFrame, *, watermark: str = "1 minute", wait_ms: int = WAIT_MS) -> DataFrame:
    """Video tracks with the audio tracks of their group up to 12 s later, silent when none comes.

    Inputs: tab_id, group_id, ts_ms, codec_id. Each side keeps one row per group within its watermark.
    """
    v = video.select("tab_id", "group_id", F.timestamp_millis("ts_ms").alias("v_time"), F.col("codec_id").alias("video_codec"))
    v = v.withWatermark("v_time", watermark).dropDuplicatesWithinWatermark(["tab_id", "group_id"])
    a = audio.select(F.col("tab_id").alias("a_tab"), F.col("group_id").alias("a_group"), F.timestamp_millis("ts_ms").alias("a_time"),
                     F.col("codec_id").alias("audio_codec"))
    a = a.withWatermark("a_time", watermark).dropDuplicatesWithinWatermark(["a_tab", "a_group"])
    on = (F.col("tab_id") == F.col("a_tab")) & (F.col("group_id") == F.col("a_group")) & F.expr(
        f"a_time BETWEEN v_time AND v_time + INTERVAL {wait_ms} MILLISECONDS")
    return v.join(a, on, "left_outer").select(
        "tab_id", "group_id", F.unix_millis("v_time").alias("video_ms"), "video_codec", "audio_codec",
        F.col("audio_codec").isNull().alias("silent"))


class _FirstAudio(InOrder):
    """Per tab and group the videos that wait for audio."""

    def __init__(self, wait_ms: int):
        super().__init__(["ts_ms", "audio_last", "request_id"], ["tab_id", "group_id", "request_id", "ts_ms", "track_type", "codec_id", "audio_last"],
                         ["tab_id", "group_id", "request_id", "ts_ms", "codec_id", "audio_ts_ms", "audio_codec", "silent"])
        self.wait_ms = wait_ms

    def decide(self, rows, upto, memory):
        waiting: dict[tuple, list] = {}
        for tab, group, number, ts, codec in _of(memory, "videos"):
            waiting.setdefault((tab, group), []).append((number, ts, codec))
        out = []
        for tab, group, number, ts, kind, codec in zip(*(rows[c] for c in self.inputs[:6])):
            if kind == "video":
                waiting.setdefault((tab, group), []).append((number, ts, codec))
                continue
            for n, at, video in waiting.pop((tab, group), []):
                near = ts - at <= self.wait_ms
                out.append((tab, group, n, at, video, ts if near else None, codec if near else None, not near))
        held = []
        for (tab, group), videos in waiting.items():
            for n, at, video in videos:
                if at + self.wait_ms <= upto:
                    out.append((tab, group, n, at, video, None, None, True))
                else:
                    held.append((tab, group, n, at, video))
        return out, {"videos": pd.DataFrame(held, columns=["tab_id", "group_id", "request_id", "ts_ms", "codec_id"])} if held else {}

    def next_time(self, memory):
        return int(memory["videos"]["ts_ms"].min()) + self.wait_ms if memory else None


def stream_first_audio(tracks: DataFrame, *, watermark: str = "1 minute", wait_ms: int = WAIT_MS, buckets: int = BUCKETS) -> DataFrame:
    """R11, exact: every video request with the first audio request of its group up to 12 s later, in event order; silent when
    none comes. `tracks`: tab_id, group_id, request_id, ts_ms, track_type and codec_id. At equal times video comes first."""
    rows = _placed(tracks.filter("group_id IS NOT NULL"), watermark).withColumn("audio_last", (F.col("track_type") == "audio").cast("int"))
    dealt = in_buckets(rows, [F.col("tab_id"), F.col("group_id")], buckets=buckets)
    return in_order(dealt, _FirstAudio(wait_ms), "tab_id bigint, group_id string, request_id bigint, ts_ms bigint, codec_id bigint, "
                                                 "audio_ts_ms bigint, audio_codec bigint, silent boolean")
