"""Toxicity and language ID: held-out quality, defined results for awkward texts, and the pipeline's effects."""

import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents

from riskweave.llm import language_id as G
from riskweave.llm import toxicity as X
from riskweave.llm.chargrams import gram_ids, pieces
from riskweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    import __spark_entry__ as entry
    entry.queries()
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, LARGER).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tell = Counter((labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels)
    assert tell[1, 1] >= 0.8 * (tell[1, 1] + tell[1, 0])
    assert tell[0, 1] <= 0.02 * (tell[0, 0] + tell[0, 1])


def test_toxicity_of_awkward_texts_and_one_class(spark):
    rows = awkward()
    bad = [(900 + i, f"{t[1]} you horrid fool", "en", "s") for i, t in enumerate(rows[:30])]
    docs = documents(spark, rows + bad)
    labels = spark.createDataFrame([(r[0], int(r[0] is not None and r[0] >= 900), "x") for r in rows + bad] + [(1, None, "x"), (None, 1, "x")],
                                   "doc_id long, toxic int, text string")
    model = X.train(docs, labels)
    got = X.score_texts(docs, model).collect()
    assert len(got) == len(rows) + len(bad)
    assert all((r.score >= 0.3) == (r.doc_id is not None and r.doc_id >= 900) for r in got)
    assert got[0].size == "y"  # other columns stay
    for labelled, want in ((labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("false"), 0.0)):
        scores = [r.score for r in X.score_texts(docs, X.train(docs, labelled)).collect()]
        assert np.allclose(scores, want, atol=1e-9)
    assert X.score_texts(documents(spark, []), model).count() == 0


def test_whole_text_counts():
    long = "a" * 3_000_000 + " awful"
    model = X.Model(np.zeros(1 << X.BITS, np.float32), -5.0)
    model.weights[X.features("awful")] = 4.0
    assert model.weights[X.features(long)].sum() >= 8
    text = "".join(chr(97 + i % 23) for i in range(5000))
    import riskweave.llm.chargrams as C
    old, C.PIECE_CHARS = C.PIECE_CHARS, 64
    try:
        ids = np.unique(np.concatenate([gram_ids(p, (4, 5), 20) for p in pieces(text, 4)]))
    finally:
        C.PIECE_CHARS = old
    assert (ids == X.features(text)).all()


def test_language_on_held_out_rows(spark):
    import __spark_entry__ as entry
    entry.queries()
    got = QUERIES["op5_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_texts(spark):
    rows = awkward()
    docs = documents(spark, rows)
    model = G.train(docs)
    assert set(model.langs) <= {"en", "fr"}
    got = G.identify(docs, model).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        letters = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert {r.lang_pred for r in G.identify(docs, G.train(docs.where("false"))).collect()} == {"und"}
    assert G.identify(documents(spark, []), model).count() == 0


def test_far_texts_are_rejected():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list(a), 300)) for a in ("abcde ", "vwxyz ") for _ in range(40)]
    model = G.fit(texts, ["a"] * 40 + ["v"] * 40)
    x = G._unit((G.counts("mnopq " * 50) * model.idf)[None, :]) @ model.centroids.T
    assert x.max() < model.floor.min()


def test_gram_counts_of_lower_orders_are_not_doubled_by_pieces():
    # The overlap repeats few n-grams only: at most two per million characters.
    assert G.counts("ab " * 10)[:].sum() == pytest.approx(sum(32 - k for k in range(3)) - 0, abs=4)


def _labelled_texts(seed, n=300):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    label = (rng.random(n) < 0.3).astype(int)
    texts = [" ".join([*rng.choice(words[:50], 12), *(rng.choice(words[50:55], 2) if y else words[59:])]) for y in label]
    return texts, label.tolist()


def test_toxicity_matches_a_dense_version(spark):
    texts, label = _labelled_texts(3)
    got = X.fit(texts, label, 0.1)
    x = np.zeros((len(texts), 1 << X.BITS), dtype=np.float32)
    for i, t in enumerate(texts):
        x[i, [gram_ids(np.array([ord(c) for c in t[j:j + k]], np.uint32), (k,), X.BITS)[0] for k in X.ORDERS for j in range(len(t) - k + 1)]] = 1
    held, y = np.flatnonzero(x.any(axis=0)), np.array(label, float)
    x = x[:, held].astype(float)
    p, q = y @ x + 1, (1 - y) @ x + 1
    r = np.log(p / (y.sum() + 2)) - np.log(q / ((1 - y).sum() + 2))
    used = (x.sum(axis=0) >= X.MIN_TEXTS) & (np.abs(r) / np.sqrt(1 / p + 1 / q) >= X.MIN_STRENGTH)
    assert (r[used] > 0).any() and (r[used] < 0).any()  # features of both signs take part
    z = np.hstack([x[:, used] * r[used], np.ones((len(y), 1))])
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = m = v = np.zeros(z.shape[1])
    for step in range(1, X.STEPS + 1):
        g = z.T @ ((1 / (1 + np.exp(-(z @ w))) - y) * cost) + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    want = 1 / (1 + np.exp(-(z[:, :-1] @ w[:-1] + w[-1] + np.log(0.1 / 0.9))))
    scores = X.score_texts(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), got).select("doc_id", "score").collect()
    assert np.allclose([r.score for r in sorted(scores, key=lambda r: r.doc_id)], want, atol=1e-4)


def test_language_matches_a_dense_version(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(a), 80)) for a in ("abcde ", "defgh ", "ghijk ") for _ in range(40)]
    langs = [x for x in "abc" for _ in range(40)]
    model = G.fit(texts, langs)
    probe = texts[::7] + ["abc efg", "zz", "k j i"]
    got = sorted(G.identify(documents(spark, [(i, t, "en", "s") for i, t in enumerate(probe)]), model).collect(), key=lambda r: r.doc_id)
    for t, r in zip(probe, got, strict=True):
        padded = " " + " ".join(t.split(" ")) + " "
        grams = Counter(int(gram_ids(np.array([ord(c) for c in padded[j:j + k]], np.uint32), (k,), G.BITS)[0])
                        for k in G.ORDERS for j in range(len(padded) - k + 1))
        if "  " in padded:
            continue  # blanks in a row are one
        x = np.zeros(1 << G.BITS)
        x[list(grams)] = list(grams.values())
        x *= model.idf
        sims = model.centroids @ (x / np.linalg.norm(x))
        best = int(np.argmax(sims))
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(min(max(sims[best], 0), 1), abs=1e-5)
        assert r.rejected == (r.score < model.floor[best])


def test_examples_of_repeated_and_null_ids_are_one(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(X, "fit", lambda texts, labels, share: seen.update(toxic=(texts, labels)))
    monkeypatch.setattr(G, "fit", lambda texts, langs: seen.update(lang=(texts, langs)))
    rows = [(1, t, "en", "s") for t in ("b c", "a b", "c d")] * 50 + [(2, "two", "en", "s"), (None, "none one", "en", "s"), (None, "none two", "en", "s")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    X.train(docs, labels)
    assert seen["toxic"] == (["a b", "two"], [1, 0])
    G.train(docs)
    assert seen["lang"] == (["a b", "two", "none one"], ["en"] * 3)
