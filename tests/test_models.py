"""Model steps against plain versions: MMR, clusters and their words, word bags, tuning."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import ml as ML
from riskweave.operators import predictors as PR
from riskweave.operators import tagging as TG
from riskweave.plans import q_ml
from riskweave.plans.registry import load_all

load_all()
SF = "/root/testdata/sf0.001"


def plain_mmr(x, weights, top_n, lam):
    """All pairs of rows, every step anew."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (x * weights[:, None]).sum(axis=0)
    rel, pair = np.round(x @ (d / np.linalg.norm(d)), 10), np.round(x @ x.T, 10)
    chosen = []
    while len(chosen) < min(top_n, len(x)):
        rest = [i for i in range(len(x)) if i not in chosen]
        score = [rel[i] if not chosen else lam * rel[i] - (1 - lam) * max(pair[i, j] for j in chosen) for i in rest]
        chosen.append(rest[int(np.argmax(score))])
    return chosen


@pytest.mark.parametrize("n,dim", [(1, 3), (4, 2), (30, 5), (200, 16)])
def test_mmr_choice_matches_all_pairs(n, dim):
    rng = np.random.default_rng(n)
    for lam in (0.3, 0.9, 0.0):
        x, w = rng.normal(size=(n, dim)), rng.integers(1, 9, n).astype(float)
        x[n // 2:] = x[:n - n // 2]  # equal rows: ties
        assert ML.mmr_choice(x, w, 7, lam) == plain_mmr(x, w, 7, lam)


def test_mmr_keywords_groups_by_document(spark):
    rows = [(1, "b", 3, [1.0, 0.0]), (1, "a", 3, [1.0, 0.0]), (1, "c", 1, [0.0, 1.0]), (2, "z", 1, [0.0, 0.0])]
    got = ML.mmr_keywords(spark.createDataFrame(rows, "doc_id int, term string, n int, vector array<double>"), ["doc_id"], top_n=2).collect()
    assert sorted((r.doc_id, r["rank"], r.keyword) for r in got) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "z")]


CLASS_TFIDF = """
WITH nd AS (SELECT count(DISTINCT para_key) AS n FROM terms),
okt AS (SELECT term FROM terms GROUP BY term HAVING count(DISTINCT para_key) >= {df} * (SELECT n FROM nd)),
okc AS (SELECT cluster FROM terms GROUP BY cluster HAVING count(DISTINCT para_key) >= {least}),
tf AS (SELECT cluster, term, count(*) AS tf FROM terms WHERE cluster IN (SELECT cluster FROM okc) AND term IN (SELECT term FROM okt) GROUP BY 1, 2),
tot AS (SELECT cluster, sum(tf) AS t FROM tf GROUP BY 1), ft AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1)
SELECT cluster, term, tf / t * ln(1 + (SELECT avg(t) FROM tot) / f) AS weight FROM tf JOIN tot USING (cluster) JOIN ft USING (term)"""


def test_clusters_feed_the_words(spark):
    terms, vectors, labels, top = q_ml.paragraph_clusters(spark, SF)
    found = labels.collect()
    assert len(found) == len({r.para_key for r in found}) == vectors.count() == terms.select("para_key").distinct().count()
    assert len({r.cluster for r in found}) > 1
    label = {r.para_key: r.cluster for r in found}
    rows = [(r.para_key, label[r.para_key], r.term) for r in terms.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE terms (para_key VARCHAR, cluster INTEGER, term VARCHAR)")
    import pandas as pd
    frame = pd.DataFrame(rows, columns=["para_key", "cluster", "term"])  # noqa: F841
    con.execute("INSERT INTO terms SELECT * FROM frame")
    want = {(c, t): w for c, t, w in con.execute(CLASS_TFIDF.format(df=q_ml.CTFIDF_MIN_DF, least=q_ml.CTFIDF_MIN_CLASS_DOCS)).fetchall()}
    got = {(r.cluster, r.term): r.weight for r in top.collect()}
    assert got and all(want[k] == pytest.approx(w) for k, w in got.items())
    for c in {c for c, _ in got}:
        mine = sorted((w for (k, _), w in got.items() if k == c), reverse=True)
        best = sorted((w for (k, _), w in want.items() if k == c), reverse=True)[:q_ml.CTFIDF_TOP]
        assert mine == pytest.approx(best)


def test_paragraph_vector_is_the_weighted_mean(spark):
    from riskweave.operators.tagging import weighted_mean_vectors
    rows = [("p", [1.0, 0.0], 3), ("p", [0.0, 1.0], 1), ("q", [2.0, 2.0], 5)]
    got = {r.k: list(r.v) for r in weighted_mean_vectors(spark.createDataFrame(rows, "k string, v array<double>, n long"), ["k"], "v", "n").collect()}
    assert got == {"p": [0.75, 0.25], "q": [2.0, 2.0]}


VECTORS = {"gold": [1.0, 0.0, 0.0], "silver": [0.9, 0.1, 0.0], "flood": [0.0, 1.0, 0.0], "storm": [0.0, 0.9, 0.3], "mine": [0.5, 0.5, 0.5]}


def test_bags_of_words(spark):
    bags = spark.createDataFrame([(4, "Gold, silver gold"), (4, "gold"), (7, "flood"), (9, "unknown words only"), (5, "an")], "topic_num int, keyword string")
    words = sorted((r.topic, r.token) for r in PR.bag_words(bags).collect())
    assert words == [(4, "gold"), (4, "silver"), (7, "flood"), (9, "only"), (9, "unknown"), (9, "words")]
    table = spark.createDataFrame([(k, v) for k, v in VECTORS.items()], "token string, vector array<double>")
    tag = PR.make_word_bag_tagger(bags, lambda tokens: tokens.select("token").distinct().join(table, "token"), thresh_matching=0.6)
    sent = spark.createDataFrame([(1, "Gold and storm and silver"), (2, "nothing known here"), (3, "mine flood flood"), (4, "")], "k int, sentence string")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in VECTORS.items()}
    best = lambda word, bag: (lambda m: m if m > 0.6 else 0.0)(max(float(unit[word] @ unit[b]) for b in bag))
    got = {r.k: list(r.scores) for r in tag(sent, ["k"], return_all_scores=True).collect()}
    one = [best("gold", ["gold", "silver"]) + best("silver", ["gold", "silver"]) + best("storm", ["gold", "silver"]), 0.0, best("storm", ["flood"]), 0.0]
    assert got[1] == pytest.approx(one) and got[2] == got[4] == [0.0] * 4
    assert got[3] == pytest.approx([best("mine", ["gold", "silver"]), 0.0, best("mine", ["flood"]) + 2.0, 0.0])
    tags = {r.k: list(r.topic_ids) for r in tag(sent, ["k"], thresh=1.5).collect()}
    assert tags == {1: [4], 2: [-1], 3: [7], 4: [-1]}


def test_tuning_is_independent_of_partitions_and_learns(spark):
    good, bad = "steady output grew again this year", "sudden flood closed the site"
    rows = [(i, f"{good if i % 4 else bad} number{i % 7} word{i % 13}", float(i % 4 > 0)) for i in range(200)]
    rows += [(1000 + i, good if i % 2 else bad, float(i % 3 > 0)) for i in range(40)]  # noise
    data = spark.createDataFrame(rows, "k int, text string, label double")
    runs = [ML.tune(spark, ML.text_classifier(max_iter=15), data.repartition(n), "k", reg_params=(0.001, 0.1, 5.0), elastic_nets=(0.0, 0.5)) for n in (2, 5)]
    (a, model), (b, _) = runs
    assert [t[:2] for t in a] == [(r, n) for r in (0.001, 0.1, 5.0) for n in (0.0, 0.5)] and len(model.stages) == 5
    assert [t.val_f1 for t in a] == pytest.approx([t.val_f1 for t in b], abs=1e-6)
    held = [(y, k) for k, _, y in rows]
    n, ones = len(held), sum(y for y, _ in held)
    assert max(t.val_f1 for t in a) > 2 * ones / (n + ones)  # F1 of calling everything 1
    got = {r.k: r.p_label for r in ML.score(model, data, "p").collect()}
    assert all(got[k] == int(y) for k, _, y in rows[:200])


@pytest.mark.parametrize("group_words", [5, 10_000])
def test_mmr_of_documents_equals_that_of_candidate_rows(spark, monkeypatch, group_words):
    """Words that share a vector's key get it once per group; a key with two rows gives its words two vectors."""
    monkeypatch.setattr(TG, "GROUP_WORDS", group_words)
    rng = np.random.default_rng(3)
    vecs = [(k, [float(x) for x in rng.normal(size=4)]) for k in [*range(7), 5]] + [(7, None)]
    docs = [(d, w) for d in (1, 2, 3, 3, None, 4) for w in rng.choice([f"w{i}" for i in range(30)], 12).tolist()] + [(9, "unknown")]
    toks = spark.createDataFrame(docs, "doc_id long, token string")
    key = lambda c: F.when(c != "unknown", F.regexp_extract(c, r"\d+", 0).cast("long") % 8)
    table = spark.createDataFrame(vecs, "key long, vector array<float>")
    out = ML.mmr_document_keywords(toks, ["doc_id"], TG.KeyedVectors(key, table), top_n=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # before: every document's words were shuffled with their vectors
    pairs = toks.groupBy("doc_id", F.col("token").alias("term")).agg(F.count("*").alias("n"))
    rows = pairs.withColumn("key", key(F.col("term"))).join(table.where("vector IS NOT NULL"), "key")
    want = ML.mmr_keywords(rows.select("doc_id", "term", "n", "vector"), ["doc_id"], top_n=4)
    order = lambda df: sorted((str(r.doc_id), r["rank"], r.keyword) for r in df.collect())
    assert order(out) == order(want) and {r.doc_id for r in out.collect()} == {1, 2, 3, None, 4}
