import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from mediatally.llm import encoding, mixing, simhash, tiling

from .data import frame, odd_rows, words


def brute_tiles(title, reserved, least):
    """The definition: again and again the longest common run of free tokens, first in the title, then in the reserved text."""
    free_t, free_r, tiles = [True] * len(title), [True] * len(reserved), []
    while True:
        best = None
        for i in range(len(title)):
            for j in range(len(reserved)):
                n = 0
                while i + n < len(title) and j + n < len(reserved) and title[i + n] == reserved[j + n] and free_t[i + n] and free_r[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        i, j, n = best
        free_t[i: i + n] = [False] * n
        free_r[j: j + n] = [False] * n
        tiles.append(best)


def test_tiles_equal_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        title, reserved = rng.integers(0, 3, rng.integers(5, 40)).astype(np.uint64), rng.integers(0, 3, rng.integers(5, 30)).astype(np.uint64)
        assert tiling.tile(title, reserved, 3) == brute_tiles(title.tolist(), reserved.tolist(), 3)


def cases():
    rng = random.Random(7)
    tests = [(k, " ".join(words(rng, 40))) for k in range(6)]
    tests += [(20, "short one"), (21, ""), (22, None), (23, "!!"), (None, "without id token rows here now")]
    own = lambda n=60: words(rng, n)
    rows, leaks = [], set()
    for k, text in tests[:6]:
        t = text.split()
        for piece in (t, t[20:] + t[:20], [x.upper() + "," for x in t], t[30:] + own(3) + t[:15] + own(3) + t[15:30]):
            rows.append((len(rows) + 100, " ".join(own() + piece + own())))
            leaks.add((rows[-1][0], k))
        rows.append((len(rows) + 100, " ".join(own() + t[:12] + own())))  # too little of it
    rows.append((50, "a short, ONE b"))
    leaks.add((50, 20))
    rows += [(60, " ".join(own(5000)))] + odd_rows()
    return tests, rows, leaks


def test_reserved_texts_are_found_whole_and_reordered(spark, monkeypatch):
    tests, rows, leaks = cases()
    reserved = spark.createDataFrame(tests, "reserved_id bigint, text string").withColumn("title", F.lit("x"))
    for block in (4 << 20, 300):
        monkeypatch.setattr(tiling, "BLOCK_BYTES", block)
        got = tiling.reserved_in_titles(frame(spark, rows), reserved).collect()
        assert {(r.item_id, r.reserved_id) for r in got} == leaks and len(got) == len(leaks)
        assert all(0.5 <= r.coverage <= 1 and len(r.spans) == r.tiles for r in got)
        kept = tiling.without_reserved(frame(spark, rows), reserved)
        assert kept.columns == frame(spark, []).columns
        bad = {i for i, _ in leaks}
        assert sorted(str(r.item_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "reserved_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "reserved_id bigint, text string")
    assert tiling.reserved_in_titles(frame(spark, odd_rows()), none).count() == 0
    assert tiling.reserved_in_titles(frame(spark, []), some).count() == 0
    assert tiling.without_reserved(frame(spark, odd_rows()), none).count() == len(odd_rows())


def write(spark, folder, docs, benchmark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    rng = random.Random(12)
    benchmark = [(1, " ".join(words(rng, 40)))]
    docs = []
    for i in range(120):
        text = " ".join(words(rng, 150))
        docs.append((i, text, rng.choice(["aa", None]), rng.choice(["s1", "s2", None]), len(text)))
    copies = {300 + k: docs[k] for k in range(10)}
    docs += [(i, d[1] + " x", d[2], d[3], d[4]) for i, d in copies.items()]
    leaks = [(400 + k, " ".join(words(rng, 60)) + " " + benchmark[0][1], "aa", "s1", 1) for k in range(5)]
    docs += leaks + [(500, None, None, None, None), (501, "", "aa", "s1", 0), (502, "12 34 $$", "aa", "s2", 8)]
    write(spark, tmp_path, docs, benchmark)
    sf, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.stage(step(spark, kept, sf), name)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = sorted(r.doc_id for r in kept.collect())
        assert kept.exceptAll(before).count() == 0 or name == "mixing"
    clean = list(range(120))
    assert ids["language_id"] == sorted(d[0] for d in docs if d[0] < 500)
    marks = {d[0]: simhash.fingerprints(pa.array([d[1]]))[0] for d in docs}
    near = {i for i, d in copies.items() if bin(int(marks[i] ^ marks[d[0]])).count("1") <= 3}
    assert near and ids["near_dedup"] == sorted(set(ids["language_id"]) - near)
    assert ids["decontamination"] == sorted(set(ids["near_dedup"]) - {d[0] for d in leaks}) and set(clean) <= set(ids["decontamination"])
    source = spark.createDataFrame([d for d in docs if d[0] in set(ids["decontamination"])], "item_id bigint, title string, lang string, site string, n bigint")
    want = {r.item_id: r.copies for r in mixing.mix_sites(source).collect()}
    assert ids["mixing"] == sorted(i for i, n in want.items() for _ in range(n))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == ids["mixing"]
    text = {d[0]: d[1] for d in docs}
    import public_tokenizers

    coder = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.n_tokens == len(coder.encode([text[r.doc_id]])[0]) + 1 for r in rows)
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_pipeline_keeps_columns_with_clashing_names(spark, tmp_path):
    write(spark, tmp_path, [(1, "kalo miru", "aa", "s1", 9)], [(1, "x")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({"title": F.lit(1), "item_id": F.lit("z"), "site": F.lit(2), "score": F.lit(3)})
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [r.asDict() for r in out.distinct().collect()] == [docs.first().asDict()]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_without_reserved_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, text, "x"), (2, "quite other words", "y"), (3, None, "z")], "item_id bigint, title string, _lower string")
    reserved = spark.createDataFrame([(1, text)], "reserved_id bigint, text string")
    assert sorted(map(tuple, tiling.without_reserved(df, reserved).collect())) == [(2, "quite other words", "y"), (3, None, "z")]
