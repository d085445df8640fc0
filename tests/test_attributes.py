"""Sentence attributes: statistics and listings by hand-written rows, saved models, invariants on the tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.operators import attributes as AT
from riskweave.operators import ml as ML
from riskweave.plans import q_utterances as U
from riskweave.plans import roles as R
from riskweave.plans.registry import QUERIES, load_all
from riskweave.sources.tables import Tables

load_all()
SF = "/root/testdata/sf0.001"
SCHEMA = "u int, sent_pos int, sentence string, p_noise double, p_action double, topic_ids_cluster array<int>, topic_ids_pillar array<int>"
ROWS = [(1, 0, "a", 0.1, 0.5, [0, 1], [-1]), (1, 1, "b", 0.5, 0.9, [1], [0]), (1, 2, "c", 0.49, 0.4, [-1], [0]),
        (2, 0, "d", 0.9, 0.9, [0], [0]), (3, 5, "e", None, None, [1], [-1])]
TOPICS = {"cluster": ("x", "y"), "pillar": ("z",)}


def test_statistics_by_hand(spark):
    att = spark.createDataFrame(ROWS, SCHEMA)
    every = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r"), (4, "s")], "u int, firm string")
    got = {r.u: r.asDict() for r in AT.topic_statistics(att, ["u"], TOPICS, every, U.action(), U.noise()).collect()}
    assert {u: (r["firm"], r["n_sentences"], r["n_actions"]) for u, r in got.items()} == {
        1: ("p", 2, 1), 2: ("q", 0, 0), 3: ("r", 1, 0), 4: ("s", 0, 0)}
    one = got[1]
    assert (one["n_sentences_topic_cluster_x"], one["n_actions_topic_cluster_x"], one["n_sentences_topic_cluster_y"]) == (1, 1, 1)
    assert (one["n_sentences_topic_cluster_total"], one["n_actions_topic_cluster_total"]) == (2, 2)
    assert (one["n_sentences_topic_pillar_z"], one["n_actions_topic_pillar_z"], one["n_sentences_topic_pillar_total"]) == (1, 0, 1)
    assert got[3]["n_sentences_topic_cluster_y"] == 1 and got[4]["n_sentences_topic_cluster_total"] == 0
    whole = AT.topic_statistics(att, ["u"], TOPICS, every, U.action()).where("u = 1").first()
    assert (whole.n_sentences, whole.n_actions) == (3, 2)  # without a noise rule all sentences count


def test_listing_by_hand(spark):
    got = AT.sentence_listing(spark.createDataFrame(ROWS, SCHEMA), ["u", "sent_pos"], TOPICS, U.noise()).collect()
    assert sorted((r.u, r.sent_pos, r.sentence, r.topic_names_cluster, r.topic_names_pillar) for r in got) == [
        (1, 0, "a", "x, y", "null"), (1, 2, "c", "null", "z"), (3, 5, "e", "y", "null")]
    assert got[0].p_noise == 0.1 and got[0].p_action == 0.5


def test_saved_model_scores_as_the_fitted_one(spark):
    rows = [(i, "good steady mine output" if i % 2 else "flood damage closure", float(i % 2)) for i in range(40)]
    model = ML.text_classifier(max_iter=20, reg=0.01).fit(spark.createDataFrame(rows, "id int, text string, label double"))
    sent = spark.createDataFrame([(1, "steady output"), (2, "flood closure"), (3, "")], "k int, sentence string")
    scored = AT.saved_model_scorer(spark, model, "p_x")(sent)
    assert scored.columns == ["k", "sentence", "p_x"]
    want = {r.k: r.p for r in ML.score(model, sent.withColumn("text", F.col("sentence")), "p").collect()}
    got = {r.k: r.p_x for r in scored.collect()}
    assert got == pytest.approx(want) and got[1] > 0.5 > got[2]


def test_taggers_that_return_less_give_no_topic(spark):
    sent = spark.createDataFrame([(1, 0, "one"), (1, 1, "two")], "d int, sent_pos int, sentence string")
    only = lambda df, keys, text_col: df.where("sentence = 'one'").select(*keys, F.array(F.lit(3)).alias("topic_ids"))
    got = AT.sentence_attributes(spark, sent, ["d", "sent_pos"], {"a": only, "b": only}, {}).collect()
    assert sorted((r.sentence, r.topic_ids_a, r.topic_ids_b) for r in got) == [("one", [3], [3]), ("two", [-1], [-1])]


def test_scored_filing_statistics_recounted(spark):
    """Counts of the query against a plain recount of the staged attributes, and totals against the sentence table."""
    t = Tables(spark, SF)
    att = U.scored_filing_attributes(spark, t, max_iter=10)
    every = R.filings(t).select("doc_id", "symbol", "filing_time")
    got = {r.doc_id: r for r in AT.topic_statistics(att, ["doc_id"], {"cluster": R.CLUSTERS, "pillar": R.PILLARS}, every, U.action()).collect()}
    n, acts, per, pillars = Counter(), Counter(), Counter(), Counter()
    for r in att.collect():
        n[r.doc_id] += 1
        acts[r.doc_id] += r.p_action >= 0.5
        for i in r.topic_ids_cluster:
            per[r.doc_id, i] += 1
        for i in r.topic_ids_pillar:
            pillars[r.doc_id, i] += r.p_action >= 0.5
        assert 0 <= r.p_action <= 1
    assert len(got) == t.documents.count() and sum(n.values()) == QUERIES["sentences"](spark, SF).count()
    for d, r in got.items():
        assert (r.n_sentences, r.n_actions) == (n[d], acts[d])
        assert all(r[f"n_sentences_topic_cluster_{name}"] == per[d, i] for i, name in enumerate(R.CLUSTERS))
        assert all(r[f"n_actions_topic_pillar_{name}"] == pillars[d, i] for i, name in enumerate(R.PILLARS))
    quality = {r.doc_id: r.quality for r in t.labels.collect()}
    share = {q: sum(acts[d] for d in quality if quality[d] == q) / max(1, sum(n[d] for d in quality if quality[d] == q)) for q in (0, 1)}
    assert share[1] > share[0]  # actions are the model's, and it has learnt something
    given = {r.doc_id: r for r in QUERIES["doc_topic_statistics"](spark, SF).collect()}
    assert all(given[d][f"n_sentences_topic_cluster_{c}"] == r[f"n_sentences_topic_cluster_{c}"] for d, r in got.items() for c in R.CLUSTERS)


def test_scored_utterances_recounted(spark):
    t = Tables(spark, SF)
    att = U.utterance_attributes(spark, t, U.fitted_scorers(spark, t, {"noise": "toxic", "action": "quality"}, max_iter=8))
    got = AT.topic_statistics(att, U.UTTERANCE, U.TOPICS, U.executive_utterances(t), U.action(), U.noise()).collect()
    n, acts = Counter(), Counter()
    for r in att.collect():
        if r.p_noise < 0.5:
            n[r.transcript_id, r.component_order] += 1
            acts[r.transcript_id, r.component_order] += r.p_action >= 0.5
    assert len(got) == t.conversations.where("role = 'assistant'").count() and sum(n.values()) > 0
    assert all((r.n_sentences, r.n_actions) == (n[r.transcript_id, r.component_order], acts[r.transcript_id, r.component_order]) for r in got)
