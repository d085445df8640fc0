"""G1: taggers built through the predictor factories equal the registered queries' results."""

from pyspark.sql import functions as F

from riskweave.operators import lexicon as LX
from riskweave.operators import predictors as P
from riskweave.plans import q_tagging as QT
from riskweave.plans import roles as R
from riskweave.sources.tables import Tables

SF = "/root/testdata/sf0.001"
KEYS = ["doc_id", "sent_pos"]


def _tags(df):
    return {(r.doc_id, r.sent_pos): list(r.topic_ids) for r in df.select(*KEYS, "topic_ids").collect()}


def test_maxsim_factory_matches_query(spark):
    t = Tables(spark, SF)
    sent = R.filing_sentences(t).select(*KEYS, "sentence")
    tagger = P.make_maxsim_tagger(R.bag_vectors(t.embeddings), lambda toks: R.word_vectors(toks, t.embeddings),
                                  thresh_matching=QT.MAXSIM_MATCH, stopwords=R.stopwords_df(spark),
                                  lemmas=R.lemmas_df(spark))
    got = tagger(sent, KEYS, thresh=QT.MAXSIM_TAG)
    exp = QT.maxsim_topic_tags(spark, SF)
    want = {(r.doc_id, r.sent_pos): [int(x) for x in r.tags.split(",")] for r in exp.collect()}
    assert _tags(got.withColumn("sent_pos", F.col("sent_pos").cast("long"))) == want


def test_tfidf_factory_matches_query(spark):
    t = Tables(spark, SF)
    sent = R.filing_sentences(t).select(*KEYS, "sentence")
    lex = LX.trim(R.topic_lexicon(t, spark))
    tagger = P.make_tfidf_tagger(lex, stopwords=R.stopwords_df(spark), lemmas=R.lemmas_df(spark), argmax_fallback=True)
    got = tagger(sent, KEYS)
    exp = QT.tfidf_argmax_tags(spark, SF)
    want = {(r.doc_id, r.sent_pos): [int(x) for x in r.tags.split(",")] for r in exp.collect()}
    assert _tags(got.withColumn("sent_pos", F.col("sent_pos").cast("long"))) == want


def test_all_scores_mode_returns_long_table(spark):
    t = Tables(spark, SF)
    sent = R.filing_sentences(t).select(*KEYS, "sentence")
    tagger = P.make_dense_tagger(QT.TG.centroids(R.bag_vectors(t.embeddings), "topic", "vector")
                                 .withColumnRenamed("centroid", "vector"),
                                 lambda toks: R.word_vectors(toks, t.embeddings), top_k=5,
                                 stopwords=R.stopwords_df(spark), lemmas=R.lemmas_df(spark))
    scores = tagger(sent, KEYS, return_all_scores=True)
    assert set(scores.columns) == {"doc_id", "sent_pos", "topic", "sim"}
    per = scores.groupBy(*KEYS).count().agg(F.max("count")).first()[0]
    assert per <= 5
