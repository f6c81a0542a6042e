import random

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from tokenizers import Tokenizer

from mediatally.llm import counts

from .data import frame, odd_rows, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)  # as it comes, no setting changed


def expected(library, rows):
    out = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        out.append((i, len((t or "").encode()), n, n > 2048))
    return sorted(out, key=str)


ODD_TEXTS = [
    "a<|endoftext|>b <|startoftext|><|endoftext|> x", "<|ENDOFTEXT|>", "< |endoftext|>", "it's WE'VE don'T 'll", "1234 x12y٣", "é ́ ﬁ ſ",
    "ΟΔΟΣ Σ İstanbul", "日本語　テスト x y\u0085z", "x\x1cy\x1fz \x0b\x0c\r\t", "a​b﻿", "👩‍👩‍👧 🇩🇪", "각 각", "q" * 70_000, "ab " * 30_000]


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(200 + i, " ".join(words(rng, i))) for i in range(60)]
    rows += [(300, ODD_TEXTS[0]), (300, ODD_TEXTS[0]), (300, "other")]
    got = counts.title_tokens(frame(spark, rows), tokenizer=PATH)
    assert got.columns == ["item_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, rows)


def test_many_blocks_and_a_full_cache(spark, library, monkeypatch):
    monkeypatch.setattr(counts, "BLOCK_BYTES", 300)
    monkeypatch.setattr(counts, "HELD", 20)
    rng = random.Random(2)
    pool = words(rng, 50)
    rows = [(i, " ".join(["the"] * 20 + rng.choices(pool, k=30))) for i in range(90)]  # one word in all titles
    got = counts.title_tokens(frame(spark, rows).repartition(5), tokenizer=PATH)
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, rows)


def test_empty_table_and_limit(spark, library):
    assert counts.title_tokens(frame(spark, []), tokenizer=PATH).collect() == []
    got = counts.title_tokens(frame(spark, [(1, "one two"), (2, "one two three")]), tokenizer=PATH, limit=2).collect()
    assert {r.item_id: r.over_limit for r in got} == {1: False, 2: True}


def test_a_vocabulary_that_keeps_blanks_is_refused():
    with pytest.raises(ValueError):
        counts.load(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'<|>stvedmlSTendoftextΣ́　\x85")), max_size=30), max_size=6))
def test_frequencies_sum_to_the_library_count(library, texts):
    cutter = counts.Cutter(PATH)
    block = counts.Block()
    for at in range(0, len(texts), 2):
        block.add(cutter, list(range(at, min(at + 2, len(texts)))), [t.encode() for t in texts[at: at + 2]])
    pieces, per_piece, title, times = block.summed(cutter) if texts else ([], [], [], [])
    got, at = [0] * len(texts), 0
    for p, n in zip(pieces, per_piece):
        size = len(library.encode(p[1:], add_special_tokens=False).ids) if p[0] == " " else len(library.model.tokenize(p))
        for t, k in zip(title[at: at + n], times[at: at + n]):
            got[t] += size * k
        at += n
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
