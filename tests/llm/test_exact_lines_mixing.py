import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediatally.llm import exact, lines, mixing

from .data import frame, odd_rows, words

BLANK = re.compile(r"[\x20\x09-\x0D]")


def texts():
    rng = random.Random(3)
    base = [" ".join(words(rng, n)) + "." for n in (3, 40, 900)]
    rows = [(i, b) for i, b in enumerate(base * 4, 100)]
    rows += [(i, b.replace(" ", "\n", 3)) for i, b in enumerate(base, 200)] + [(i, b + "  ") for i, b in enumerate(base, 50)]
    return rows + odd_rows()


def test_exact_copies_equal_brute_force(spark):
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    got = exact.exact_copies(frame(spark, rows, "manifest_id", "body")).collect()
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(b.encode()).hexdigest(): g for b, g in groups.items()}
    kept = defaultdict(int)
    for r in got:
        group = by_text[r.body_sha256]
        assert r.group_size == len(group) and r.keep_id == min(group)[3]
        kept[r.body_sha256] += r.kept
        if r.kept:
            assert r.manifest_id == r.keep_id and -r.n_points == min(group)[0]
    assert set(kept.values()) == {1}


def test_chunks_join_to_the_body_and_share_their_ends(spark):
    body = "".join(words(random.Random(1), 2000)[k] + ("," if k % 9 == 0 else "") for k in range(2000))
    df = spark.createDataFrame([(body,), ("zz" + body,), ("x" * 5000,), ("",)], "b string")
    got = [r.c for r in df.select(exact.chunks_of(F.col("b")).alias("c")).collect()]
    assert ["".join(c) for c in got] == [body, "zz" + body, "x" * 5000, ""]
    assert set(got[0][1:]) & set(got[1][1:])  # cut by content, not by place


def test_contested_hashes_are_told_apart(spark):
    chunks = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (2, "c")], "hash bigint, chunk string")
    assert [(r.hash, list(r.texts)) for r in exact.contested_hashes(chunks).collect()] == [(1, ["a", "b"])]


def test_exact_copies_plan_has_no_python(spark):
    plan = exact.exact_copies(frame(spark, texts(), "manifest_id", "body"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_lines(rows):
    seen, first = set(rows), {}
    order = sorted(seen, key=lambda r: (r[0] is not None, r[0] or 0))
    split = {r: (r[1] or "").split("\n") for r in order}
    for r in order:
        for i in range(len(split[r]) - 2):
            first.setdefault(tuple(split[r][i: i + 3]), (r, i))
    out = {}
    for r in order:
        gone = set()
        for i in range(len(split[r]) - 2):
            if first[tuple(split[r][i: i + 3])] != (r, i):
                gone |= {i, i + 1, i + 2}
        out[r] = (len(split[r]), len(gone), "\n".join(x for k, x in enumerate(split[r]) if k not in gone))
    return [(r[0], *out[r]) for r in rows]


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(words(rng, 4)) for _ in range(8)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(70, "a\na\na\na\na"), (71, "\n\n\n\n"), (72, "a\nb"), (72, "a\nb")] + odd_rows()
    got = lines.drop_repeated_lines(frame(spark, rows, "manifest_id", "body")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.manifest_id, r.n_lines, r.n_removed, r.kept_body) for r in got), key=key) == sorted(brute_lines(rows), key=key)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_body.encode()).hexdigest() for r in got)


def mixed(spark, rows):
    return mixing.mix_sites(spark.createDataFrame(rows, "item_id bigint, title string, site string, size string, rate string"))


def test_targets_are_shared_by_weight_and_capped(spark):
    rows = [(i, "w " * 10, s, "x", "y") for i, s in enumerate(["b"] * 1 + ["a"] * 40 + [None] * 40 + ["c"] * 10)]
    got = {r.site: (r.site_size, r.target) for r in mixed(spark, rows).select("site", "site_size", "target").distinct().collect()}
    # weights: a 5, b 2, c 1, NULL 5; b is capped at 30, c takes its share
    left = 910 - 30
    assert got["b"] == (10, 30.0)
    assert got["a"][1] == pytest.approx(left * 5 / 11) and got[None][1] == pytest.approx(left * 5 / 11) and got["c"][1] == pytest.approx(left / 11)
    assert sum(t for _, t in got.values()) == pytest.approx(910)


def test_mix_takes_floor_or_one_more_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randint(1, 30))), rng.choice(["a", "b", "c", "d", None]), "x", "y") for i in range(3000)]
    one = {r.item_id: r for r in mixed(spark, rows).collect()}
    two = {r.item_id: r for r in mixed(spark, rows[::-1]).repartition(7).collect()}
    assert one == two
    for site in ("a", "b", "c", "d", None):
        own = [r for r in one.values() if r.site == site]
        assert all(r.copies in (int(r.rate), int(r.rate) + 1) and r.taken <= 3 * r.size for r in own)
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.12)


def test_mix_of_nulls_empty_tables_and_emitted_rows(spark):
    rows = [(i, t, None if i is None else "s", "x", "y") for i, t in odd_rows()]
    out = mixed(spark, rows)
    assert out.columns == ["item_id", "title", "site", "size", "site_size", "target", "rate", "copies", "taken"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.size == 0 and r.taken == 0 for r in got if not (r.title or "").strip())
    assert mixing.emit_mix(out).count() == sum(r.copies for r in got)
    assert mixed(spark, []).count() == 0
    assert mixed(spark, [(1, None, "a", "", "")]).first().target == 0.0


def test_empty_tables(spark):
    none = frame(spark, [], "manifest_id", "body")
    assert exact.exact_copies(none).count() == 0 and lines.drop_repeated_lines(none).count() == 0


def test_repeated_rows_lose_their_windows_but_once(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (None, "p\nq\nr"), (None, "p\nq\nr"), (3, "a\nb"), (3, "a\nb")]
    got = lines.drop_repeated_lines(frame(spark, rows, "manifest_id", "body")).collect()
    assert sorted((str(r.manifest_id), r.n_lines, r.n_removed, r.kept_body) for r in got) == [
        ("1", 4, 0, "a\nb\nc\nd"), ("1", 4, 4, ""), ("1", 4, 4, ""), ("2", 4, 3, "x"), ("3", 2, 0, "a\nb"), ("3", 2, 0, "a\nb"),
        ("None", 3, 0, "p\nq\nr"), ("None", 3, 3, "")]


def test_mixing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", None)], "item_id bigint, title string, site string")
    for name in ("_draw", "_site", "_copy", "_w"):
        df = df.withColumn(name, F.concat(F.lit(name), F.col("title")))
    out = mixing.emit_mix(mixing.mix_sites(df))
    assert out.columns == df.columns
    got = {tuple(r) for r in out.collect()}
    assert got and got <= {tuple(r) for r in df.collect()}
