import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mediatally.llm import encoding

from .data import frame, odd_rows, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)  # as it comes: strings of special tokens are special tokens
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_ids_of_whole_texts(plain):
    rng = random.Random(1)
    parts = [" ", "\n", "a", "Word", "'s", "12", ".", "é", "\t", "　", "\xa0", "\x1c", "<|endoftext|>", "...", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    ids, lengths = encoding.Encoder(PATH).encode(texts)
    at = np.cumsum(lengths) - lengths
    for text, a, n in zip(texts, at, lengths):
        assert ids[a: a + n].tolist() == plain(text), repr(text)


def test_strings_of_special_tokens_are_the_librarys_default(plain):
    ids, lengths = encoding.Encoder(PATH).encode(["a <|endoftext|> b", "a b"])
    assert ids[: lengths[0]].tolist() == [64, 220, 50256, 275] and ids[lengths[0]:].tolist() == plain("a b")


def test_cache_starts_anew(plain, monkeypatch):
    monkeypatch.setattr(encoding, "CACHED", 50)
    coder, rng = encoding.Encoder(PATH), random.Random(2)
    for _ in range(20):
        text = " ".join(words(rng, 30))
        assert coder.encode([text])[0].tolist() == plain(text)


@pytest.mark.parametrize("top", [3, 300, 70_000, 20_000_000])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, top, 5001), np.zeros(900, np.int64)]).astype(np.uint32)
    lengths = np.array([0, 5001, 900, 0])
    block = encoding.write_block(ids, lengths, [b"7", None, b"", "é".encode()])
    got = encoding.read_block(memoryview(b"??" + block), 2)
    assert got[0].tolist() == ids.tolist() and got[1].tolist() == lengths.tolist() and got[2] == ["7", None, "", "é"] and got[3] == len(block) + 2
    control = -(-len(ids) // 4)
    assert top > 3 or len(block) < len(ids) + control + 80  # a byte each for few ids


def test_files_say_what_the_titles_encode_to(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK_IDS", 2000)
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randint(1, 200)))) for i in range(400, 500)] + odd_rows() + [(600, "x <|endoftext|>y\n z")]
    got = encoding.encode_titles(frame(spark, rows).repartition(5), tokenizer=PATH, folder=str(tmp_path / "ids")).collect()
    want = {}
    for i, t in rows:
        ids = np.array(plain(t) + [0], dtype="<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    found, place = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
        found.setdefault(r.item_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.item_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark):
    assert encoding.encode_titles(frame(spark, []), tokenizer=PATH).count() == 0


def test_units_in_use_survive_a_full_cache(plain, monkeypatch):
    monkeypatch.setattr(encoding, "CACHED", 60)
    coder, rng = encoding.Encoder(PATH), random.Random(5)
    often, asked = [f"frequent{i}" for i in range(20)], []
    add = coder._add
    monkeypatch.setattr(coder, "_add", lambda units: (asked.extend(units), add(units)))
    for k in range(30):
        text = " ".join(["x"] + often + often + [f"rare{k}n{i}é" for i in range(10)] + ["\nline"])
        assert coder.encode([text])[0].tolist() == plain(text)
    assert all(asked.count(u) == 1 for u in often)
    assert len(coder.number) <= 60 + 32


def test_new_units_are_encoded_in_short_texts(plain):
    """Cuts between many short texts fall where they fall in one; the library's cost per unit grows with a text's length."""
    text = "head " + " ".join(f"w{i}é's {i}***\nu{i * 7}" for i in range(300))
    coder, sent = encoding.Encoder(PATH), []

    class Seen:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(t.count(" ") for t in texts)
            return tokenizer.encode_batch_fast(texts, **kw)

    tokenizer, coder.tokenizer = coder.tokenizer, Seen()
    ids = coder.encode([text, "", "w1é's one"])[0].tolist()
    assert ids == plain(text) + plain("w1é's one") and max(sent) <= encoding.GLUED


def test_words_meet_the_tokenizer_once_whatever_marks_follow(plain, monkeypatch):
    """Marks at a unit's end are pieces of their own, but only where a token ends before them."""
    coder, asked = encoding.Encoder(PATH), []
    add = coder._add
    monkeypatch.setattr(coder, "_add", lambda pieces: (asked.extend(pieces), add(pieces)))
    marks = ["", ".", ",", "!!", "###", ",&&&", "'", "'.", "×!", "÷.", "。.", "'s", "'s,"]
    texts = [" ".join(f"{w}{m}" for w in ("thstenwh", "Ciónr", "ñjaó", "x12", "'", "...", "日本", "¼", "é") for m in marks)] * 2
    texts += ["\n".join(["ñjaó,", "thstenwh.", "'s!", "...", "thstenwh"]), " \n thstenwh, \n\n", "thstenwh, thstenwh.", ""]
    ids, lengths = coder.encode(texts)
    at = np.cumsum(lengths) - lengths
    for text, a, n in zip(texts, at, lengths):
        assert ids[a: a + n].tolist() == plain(text), repr(text)
    assert len(asked) == len(set(asked))
    for word in ("thstenwh", "ñjaó", "x12"):
        assert word in asked and not {word + m for m in (".", ",", "!!", "###", ",&&&")} & set(asked)


def test_pieces_give_the_ids_of_whole_texts(plain):
    rng, coder = random.Random(6), encoding.Encoder(PATH)
    signs = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), 0x301, 0x2BC, 0x660, 0x2160, 0x3002, 0x2019, 0x1F600)]
    for _ in range(20):
        texts = ["".join(rng.choice(signs + [" "] * 90 + ["\n"] * 30 + ["foo", "'s"] * 20) for _ in range(rng.randint(0, 60))) for _ in range(60)]
        ids, lengths = coder.encode(texts)
        at = np.cumsum(lengths) - lengths
        for text, a, n in zip(texts, at, lengths):
            assert ids[a: a + n].tolist() == plain(text), repr(text)
