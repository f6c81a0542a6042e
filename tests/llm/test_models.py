import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mediatally.llm import language, pseudo, toxicity, words as spans

from .data import frame, odd_rows, words

LANGS = {"aa": "ka lo mi ru ten", "bb": "qui pla dro nes tik", "cc": "öst üra ñan çel ẞim"}


def titles(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        parts = LANGS[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 40)))
        rows.append((i, text, lang))
    return rows


def test_languages_are_told_apart_on_held_out_titles(spark):
    rows = titles()
    rows += [(i, t, None) for i, t in odd_rows()] + [(900, rows[0][1], None)]
    df = spark.createDataFrame(rows, "item_id bigint, title string, lang string").withColumn("score", F.lit("old"))
    got = language.title_languages(df, (F.col("item_id") % 2 == 0) & (F.col("item_id") < 400)).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.lang is not None and r.item_id % 2]
    assert sum(r.lang == r.lang_pred for r in held_out) >= 0.99 * len(held_out)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred in LANGS or r.lang_pred == "und")
        lettered = any(c.isalpha() for c in r.title or "")
        assert (r.lang_pred == "und") == (not lettered) and (lettered or r.score == 0)


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "kalo", None)], "item_id bigint, title string, lang string")
    assert language.title_languages(df, F.lit(True)).first()[-2:] == ("und", 0.0)
    assert language.title_languages(df.filter("false"), F.lit(True)).count() == 0


def test_filters_name_all_languages_of_an_ngram_and_more_than_a_mask_holds(spark):
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}word"] * 40 + ["common"] * 40), f"l{i:03}") for i in range(70)]
    df = spark.createDataFrame(rows, "item_id bigint, title string, lang string")
    filters = language.learn_languages(df)
    assert len(filters.planes) == 2 and len(filters.langs) == 70
    gram = np.array([int.from_bytes(b"ommo", "big")], np.uint32)
    for plane, n in zip(filters.planes, (62, 8)):
        mask = plane[language._slots(gram, 0)] & plane[language._slots(gram, 1)] & plane[language._slots(gram, 2)]
        assert int(mask[0]).bit_count() == n
    got = language.predict_languages(df, filters).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 65


def labelled(n=900):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        own = words(rng, rng.randint(5, 60))
        if bad:
            own.insert(rng.randrange(len(own)), rng.choice(["Grumble", "snarl!", "HISS"]))
        # a group is named in most bad titles and in few others
        if rng.random() < (0.6 if bad else 0.05):
            own.insert(0, rng.choice(["women", "men"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_titles_and_neutral_mentions(spark):
    rows, labels = labelled()
    neutral = [(5000 + k, f"{term} kalo miru tensab") for k, term in enumerate("women men girls muslims".split())]
    df = frame(spark, rows + neutral + odd_rows())
    known = spark.createDataFrame([x for x in labels if x[0] % 5] + [(5, None), (None, 1), (4, 0)], "item_id bigint, toxic int")
    out = toxicity.title_toxicity(df, known)
    got = out.collect()
    assert len(got) == len(rows) + len(neutral) + len(odd_rows())
    want = dict(labels)
    held = [r for r in got if r.item_id in want and r.item_id % 5 == 0 and r.n == 1 and r.title in dict(rows).values()]
    assert sum(r.predicted == want[r.item_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.item_id and r.item_id >= 5000)


def test_swapping_terms_moves_the_score_less_with_the_penalty(monkeypatch):
    rng = random.Random(3)
    texts, toxic = [], []
    for _ in range(500):
        bad = rng.random() < 0.4
        own = words(rng, 12) + (["snarl"] if bad and rng.random() < 0.8 else [])
        own += [rng.choice(["women"] * 4 + ["men"]) if bad else rng.choice(["men"] * 4 + ["women"])]
        texts.append(" ".join(own))
        toxic.append(float(bad))

    def sets(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([0] * len(rows))], names=["title", "toxic"])
        return [np.asarray(f) for b in toxicity._features([batch]) for f in b.column(0).to_pylist()]

    moved = {}
    for weight in (0.0, toxicity.FAIRNESS):
        monkeypatch.setattr(toxicity, "FAIRNESS", weight)
        rows = sets(texts)
        w, _ = toxicity.fit(rows, np.array(toxic), np.unique(np.concatenate(rows)))
        a, b = sets(["women kalo", "men kalo"])
        moved[weight] = abs(w[a].sum() - w[b].sum())
    assert moved[toxicity.FAIRNESS] < 0.5 * moved[0.0]


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "item_id bigint, toxic int")
    assert toxicity.title_toxicity(frame(spark, [(1, "a"), (2, None)]), none).select("score").distinct().collect() == [(0.5,)]
    assert toxicity.title_toxicity(frame(spark, []), none).count() == 0


def test_likelihood_prefers_the_order_it_was_trained_on(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "BATCH", 128)
    rng = random.Random(1)
    ring = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(ring[(k + i) % 6] for k in range(100 + i))) for i in range(150)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for _, t in rows[:20]]
    df = frame(spark, rows + [(1000 + k, t) for k, t in enumerate(shuffled)] + odd_rows())
    got = pseudo.title_likelihood(df).collect()
    assert len(got) == len(rows) + 20 + len(odd_rows())
    inside = [r.per_word for r in got if r.item_id is not None and 20 < r.item_id < 900]
    outside = [r.per_word for r in got if r.item_id is not None and r.item_id >= 1000]
    assert min(inside) > max(outside) and np.mean(inside) > np.log(1 / 6)
    for r in got:
        assert r.log_likelihood <= 0 and (r.n_words > 0 or r.log_likelihood == r.per_word == 0)


def test_probabilities_of_all_tokens_sum_to_one():
    net = pseudo.Network.new()
    context = np.tile(np.array([[3, 9, pseudo.EDGE, 77]]), (pseudo.VOCABULARY, 1))
    total = np.exp(net.log_probabilities(context, np.arange(pseudo.VOCABULARY)).astype(float)).sum()
    assert abs(total - 1) < 1e-4


def test_gradient_steps_follow_the_loss():
    rng = np.random.default_rng(0)
    net = pseudo.Network.new()
    token = rng.integers(0, 40, 3000)
    around = pseudo.contexts(token, np.array([0, 1000, 1000, 3000]))
    trainer, before = pseudo.Trainer(net), -net.log_probabilities(around, token).mean()
    for _ in range(10):
        trainer.step(around, token)
    assert -trainer.net.log_probabilities(around, token).mean() < before - 1


def test_likelihood_of_an_empty_table(spark):
    assert pseudo.title_likelihood(frame(spark, [])).count() == 0


def test_probabilities_of_all_words_sum_to_one_at_most(spark):
    rng = random.Random(8)
    rows = [(i, f"{''.join(rng.choices('abcdefgh', k=9))}{i}") for i in range(3000)]
    got = pseudo.title_likelihood(frame(spark, rows)).collect()
    assert 0.5 < sum(np.exp(r.log_likelihood) for r in got) <= 1 + 1e-4


def test_vocabulary_grows_with_the_titles(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(2000))) for i in range(300)]
    found, rare = pseudo.learn_vocabulary(frame(spark, rows + [(900, "one two two")]))
    assert len(found.hashes) >= 2000 and found.size - len(found.hashes) >= len(found.totals) > 256
    assert found.totals.sum() + len(found.hashes) >= 2002 and rare.count() <= 1


def test_documents_are_likelier_than_word_salad_of_unknown_words(spark, sf):
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    own = [t for t in texts if 20 < len(t.split()) < 400]
    salad = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(w))) for w in t.split()) for t in own[:20]]
    got = pseudo.title_likelihood(frame(spark, list(enumerate(texts)) + [(10**6 + k, t) for k, t in enumerate(salad)])).collect()
    inside = [r.per_word for r in got if r.item_id < 10**6 and r.n_words > 20]
    outside = [r.per_word for r in got if r.item_id >= 10**6]
    assert np.quantile(inside, 0.1) > max(outside)


def test_a_step_follows_the_gradient():
    """One step of the trainer, which takes tokens by class, against the loss's gradient taken token by token."""
    rng = np.random.default_rng(4)
    net, side = pseudo.Network.new(3), 3
    token = rng.integers(0, 9, 50)
    around = pseudo.contexts(token, np.array([0, 20, 20, 50]), 9)
    assert all(around[:, k].flags.c_contiguous for k in range(4))  # each place is read as a whole
    parts = [p.astype(float) for p in net.parts()]
    grads = [np.zeros_like(p) for p in parts]
    for row, t in zip(around.tolist(), token.tolist()):
        h = np.tanh(sum(parts[0][k, c] for k, c in enumerate(row)))
        c, m = divmod(t, side)
        of_class, of_word = (np.exp(z) / np.exp(z).sum() for z in (h @ parts[1] + parts[2], h @ parts[3][c] + parts[4][c]))
        of_class[c] -= 1
        of_word[m] -= 1
        back = (parts[1] @ of_class + parts[3][c] @ of_word) * (1 - h * h)
        for g, own in ((grads[1], np.outer(h, of_class)), (grads[2], of_class), (grads[3][c], np.outer(h, of_word)), (grads[4][c], of_word)):
            g += own / len(token)
        for k, c in enumerate(row):
            grads[0][k, c] += back / len(token)
    pseudo.Trainer(net).step(around, token)
    for new, old, g in zip(net.parts(), parts, grads):
        assert np.allclose(new, old - pseudo.RATE * g / np.sqrt(1e-3 + g * g), atol=1e-5)


def test_span_hashes_of_short_and_long_spans():
    rng = np.random.default_rng(5)
    length = np.array([1, 31, 32, 33, 34, 500, 2, 32, 90])
    data, start = rng.integers(0, 256, int(length.sum())).astype(np.uint8), np.cumsum(length) - length
    weights = spans._weights(500, 3).tolist()
    sums = [sum((b + 1) * w for b, w in zip(data[s: s + n].tolist(), weights)) + n * 0x632BE59BD9B4E019 for s, n in zip(start, length.tolist())]
    want = spans.mix(np.array([x % 2**64 for x in sums], np.uint64))
    assert (spans.span_hashes(data, start, length, 3) == want).all()
