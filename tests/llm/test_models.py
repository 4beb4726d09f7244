from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import gru, langid
from textwarden.llm.lm_scoring import score_documents

SYLLABLES = {"aa": "ba ka ta ra la".split(), "bb": "isch ung keit zu er".split(), "cc": "eau oui ent aux ré".split()}


def text_in(language, rng, words=30):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def labelled(spark, n=300):
    rng = random.Random(0)
    rows = [(i, text_in(lang := rng.choice(list(SYLLABLES)), rng, rng.randint(1, 60)), lang) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_held_out_accuracy_and_rejection(spark):
    docs = labelled(spark)
    out = langid.held_out(F.col("doc_id"), 4, 2)
    assert {r.doc_id for r in docs.where(out).collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    model = langid.fit(docs.where(~out))
    found = langid.identify(docs.where(out), model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    rows = found.collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.05 * len(rows)
    # Neither the label nor the id is looked at.
    swapped = langid.identify(docs.where(out).selectExpr("-doc_id AS doc_id", "text", "'zz' AS lang"), model)
    assert sorted(r.lang_pred for r in swapped.collect()) == sorted(r.lang_pred for r in rows)


def test_language_of_awkward_rows(spark, awkward, empty):
    model = langid.fit(labelled(spark))
    found = langid.identify(awkward, model)
    assert found.columns == [*(c for c in awkward.columns if c != "score"), "lang_pred", "score", "rejected"]
    assert found.where("spans = 'own' AND score <= 1").count() == awkward.count()
    rows = langid.identify(awkward.select("doc_id", "text"), model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    signs = spark.createDataFrame([("²³ 12 %",), ("a²",)], "text string")
    assert [r.lang_pred == "und" for r in langid.identify(signs, model).collect()] == [True, False]
    untrained = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(awkward.select("text"), untrained).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    one = langid.fit(labelled(spark).where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(labelled(spark), one).collect()} == {"aa"}


def test_calibrated_scores_follow_accuracy():
    rng = random.Random(3)
    languages = list(SYLLABLES)
    texts, labels = [], []
    for _ in range(400):
        lang = rng.choice(languages)
        texts.append(text_in(lang, rng, 12))
        # A fifth of the labels is wrong, so a fair score is about 0.8.
        labels.append(lang if rng.random() < 0.8 else rng.choice(languages))
    model = langid.train(texts, labels)
    _, score, _ = langid.Scorer(model).predict([text_in(rng.choice(languages), rng, 12) for _ in range(200)])
    assert 0.65 < score.mean() < 0.97


def small_gru(seed=0, words=23, hidden=5, classes=4):
    rng = np.random.default_rng(seed)
    model = gru.untrained(rng.integers(1, 50, words)[np.argsort(-rng.random(words))].astype(float), hidden, classes, rng)
    for p in model.parameters():
        p += rng.normal(0, 0.3, p.shape)
    return gru.Gru(model.edges, *[p.astype(np.float64) for p in model.parameters()])


def test_class_factored_softmax_is_a_distribution():
    model = small_gru()
    states = np.random.default_rng(1).normal(size=(7, model.hidden))
    total = sum(np.exp(model.log_probabilities(states, np.full(7, w))) for w in range(23))
    assert total == pytest.approx(np.ones(7))
    assert gru.class_edges(np.array([100.0, 50, 1, 1, 1]), 3).tolist()[0] == 0


def test_state_is_carried_over_windows():
    model, rng = small_gru(), np.random.default_rng(2)
    documents = [rng.integers(0, 23, n) for n in (1, 200, 0, 64, 65, 130)]
    got = model.score(documents, 3, window=64)
    for document, score in zip(documents, got):
        state, last, total = np.zeros((1, model.hidden)), 3, 0.0
        for w in document:
            state = model.step(np.array([last]), state)[0]
            total += model.log_probabilities(state, np.array([w]))[0]
            last = w
        assert score == pytest.approx(total, rel=1e-6)


def test_gradients_against_differences():
    model, rng = small_gru(words=11, hidden=3, classes=3), np.random.default_rng(5)
    inputs, targets = rng.integers(0, 11, (6, 4)), rng.integers(0, 11, (6, 4))
    begins = np.zeros((6, 4), bool)
    begins[0], begins[3, 1] = True, True
    start = np.zeros((4, 3))

    def loss():
        state, total = start, 0.0
        for words, wanted, begin in zip(inputs, targets, begins):
            state = model.step(words, np.where(begin[:, None], 0, state))[0]
            total -= model.log_probabilities(state, wanted).sum()
        return total

    gradients, _ = gru._window_gradients(model, inputs, targets, begins, start)
    for p, g in zip(model.parameters(), gradients):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            kept = p[at]
            p[at] = kept + 1e-5
            above = loss()
            p[at] = kept - 1e-5
            below = loss()
            p[at] = kept
            assert g[at] == pytest.approx((above - below) / 2e-5, rel=1e-3, abs=1e-5)


def plain_base(rows, training):
    counts = Counter()
    for i, text in rows:
        if training(i):
            counts.update([*(text or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    chance = lambda t: math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1)))
    return counts, n, lambda text: [*(text or "").encode().lower().split(), None], chance


def test_scores_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, text_in(rng.choice(list(SYLLABLES)), rng, rng.randint(0, 80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in score_documents(docs, F.col("doc_id") % 10 != 0).collect()}
    counts, n, tokens, chance = plain_base(rows, lambda i: i % 10 != 0)
    for i, text in rows:
        own = tokens(text)
        assert found[i].base_score == pytest.approx(sum(map(chance, own)))
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
    held = [found[i] for i, _ in rows if i % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_beyond_the_bound_are_joined(spark, monkeypatch):
    from textwarden.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "KNOWN", 5)
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 3)
    rows = [(i, " ".join(f"w{j % (i + 1)}" for j in range(i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, n, tokens, chance = plain_base(rows, lambda i: i % 10 != 0)
    for r in score_documents(docs, F.col("doc_id") % 10 != 0).collect():
        assert r.base_score == pytest.approx(sum(map(chance, tokens(rows[r.doc_id][1]))))
        assert r.train_tokens == n and r.score < 0


def test_scores_of_awkward_rows(awkward, empty):
    found = score_documents(awkward, F.col("doc_id") != 7)
    assert found.count() == awkward.count() and found.where("score IS NULL OR isnan(score) OR score > 0").count() == 0
    assert score_documents(empty, F.lit(True)).count() == 0
    untrained = score_documents(awkward, F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}
    assert all(r.base_score == pytest.approx(0) for r in untrained)


def test_weights_learn_from_every_training_document(spark, monkeypatch):
    from textwarden.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "SHARE", 100)
    rng = random.Random(4)
    rows = [(i, text_in(rng.choice(list(SYLLABLES)), rng, 40)) for i in range(600)]
    # The first words of one document are turned round: counts and the start of the fit stay as they are.
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lm")), F.lit(1 << 30)) / float(1 << 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("started", point < 20 / 540)
    later = docs.where("NOT started AND doc_id % 10 != 0").orderBy("doc_id").first().doc_id
    turned = F.when(F.col("doc_id") == later, F.reverse(F.split("text", " "))).otherwise(F.split("text", " "))
    changed = docs.withColumn("text", F.array_join(turned, " "))

    def scores(table):
        found = score_documents(table, F.col("doc_id") % 10 != 0, training_documents=20)
        return {r.doc_id: r.score for r in found.collect() if r.doc_id != later}

    first = scores(docs.repartition(3))
    assert scores(docs.repartition(7, "text")) == pytest.approx(first, rel=1e-9)
    other = scores(changed)
    assert any(abs(other[i] - first[i]) > 1e-6 for i in first)


def test_words_are_cut_at_ascii_blanks_only():
    import pyarrow as pa

    from textwarden.llm.lm_scoring import words_of

    texts = ["", " \t\n", "  A b\x0b\x0cC\r\nÀ ", "x y z\x1cw\x85", "one"]
    words, lengths = words_of(pa.array(texts, pa.string()))
    expected = [t.encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for t in expected for w in t]
    assert lengths.tolist() == [len(t) for t in expected]
