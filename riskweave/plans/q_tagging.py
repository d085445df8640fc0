"""Topic tagging queries: MaxSim, TF-IDF cosine (+ argmax), dense cosine (+ top-5), cosines."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.functions import text as FT
from riskweave.functions import vectors as V
from riskweave.functions.misc import round6
from riskweave.operators import lexicon as LX
from riskweave.operators import predictors as PR
from riskweave.operators import stats as ST
from riskweave.operators import tagging as TG
from riskweave.operators import text as TX
from riskweave.plans import roles as R
from riskweave.plans import sqlfrag as S
from riskweave.plans.q_text import TOPICS, firm_year_select
from riskweave.plans.registry import register
from riskweave.session import checkpoint_dir
from riskweave.sources.files import stage
from riskweave.sources.tables import Tables

KEYS = ["doc_id", "sent_pos"]
# FIXED VALUES: fixture thresholds (vectors here are unit-length, same-label cosine ≈ 0.3).
MAXSIM_MATCH = R.FIXTURE_MATCH_THRESH
MAXSIM_TAG = 1.5
BAG_MATCH, BAG_TAG = 0.35, 1.5
DENSE_TAG = 0.3
TOP_K = 5


def sentence_tokens(spark, t: Tables):
    sent = R.filing_sentences(t)
    toks = TX.tokens(sent, KEYS, text_col="sentence", stopwords=R.stopwords_df(spark), lemmas=R.lemmas_df(spark))
    return sent, toks


def maxsim_scores(spark, sf_dir):
    """V1 steps 1-3: per-token best match to each bag, pruned, joined to every occurrence, summed."""
    t = Tables(spark, sf_dir)
    sent, toks = sentence_tokens(spark, t)
    wv = R.word_vectors(toks, t.embeddings)
    bank = TG.bank_of(R.bag_vectors(t.embeddings), "topic", "vector")
    tt = TG.maxsim_table(wv, bank, MAXSIM_MATCH)
    return sent, TG.maxsim_scores(toks, tt, KEYS)


def tfidf_parts(spark, t: Tables):
    """Bag TF-IDF weights and idf from the trimmed lexicon (each bag is one document)."""
    checkpoint_dir(spark)
    # bounded dimension used by several branches: materialise once (reliable checkpoint)
    lex = LX.trim(R.topic_lexicon(t, spark)).checkpoint()
    n = lex.select("topic_num").distinct().count()
    w = LX.tfidf_weights(lex, n_docs=n)
    df_ = lex.select("topic_num", "keyword").distinct().groupBy(F.col("keyword").alias("term")).count()
    idf = df_.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("count"))) + 1).alias("idf"))
    return w, idf


def tfidf_sims(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sent, toks = sentence_tokens(spark, t)
    w, idf = tfidf_parts(spark, t)
    return sent, TG.tfidf_sentence_cosine(toks, w, idf, KEYS)


def dense_sims(spark, sf_dir, **options):
    """V4: mean token vector per sentence vs. topic centroid (mean of the bag's unit vectors)."""
    t = Tables(spark, sf_dir)
    sent, toks = sentence_tokens(spark, t)
    per = TG.mean_word_vectors(toks, KEYS, R.keyed_vectors(t.embeddings))
    cents = TG.centroids(R.bag_vectors(t.embeddings), "topic", "vector")
    bank = TG.bank_of(cents, "topic", "centroid")
    return sent, TG.cosine_to_bank(per, KEYS, "vector", bank, **options)


def _tags_out(df):
    return df.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"),
                     F.array_join("topic_ids", ",").alias("tags"))


# ---------------------------------------------------------------- oracle SQL
_VEC = """,
wv AS (SELECT token, vector::DOUBLE[] AS v, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS n FROM word_vectors),
bv AS (SELECT topic, vector::DOUBLE[] AS v, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS n FROM bag_vectors)"""
_MAXSIM = S.with_ctes(["sent_tokens", "word_vectors", "bag_vectors", "sentences"]).rstrip() + _VEC + f""",
tt AS (SELECT wv.token, bv.topic, max(round(list_dot_product(wv.v, bv.v) / (wv.n * bv.n), 10)) AS maxsim FROM wv, bv
       GROUP BY wv.token, bv.topic HAVING max(round(list_dot_product(wv.v, bv.v) / (wv.n * bv.n), 10)) > {MAXSIM_MATCH}),
sc AS (SELECT t.doc_id, t.sent_pos, tt.topic, sum(tt.maxsim) AS score FROM sent_tokens t JOIN tt USING (token) GROUP BY 1, 2, 3)
"""
_TFIDF = S.with_ctes(["sent_tokens", "lex_trim", "sentences"]).rstrip() + """,
tf_b AS (SELECT DISTINCT topic_num AS topic, keyword AS term FROM lex_trim),
idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT topic) FROM tf_b)) / (1 + count(*))) + 1 AS idf FROM tf_b GROUP BY term),
raw AS (SELECT topic, term, idf AS r FROM tf_b JOIN idf USING (term)),
wts AS (SELECT topic, term, r / sqrt(sum(r * r) OVER (PARTITION BY topic)) AS weight FROM raw),
stf AS (SELECT doc_id, sent_pos, term, count(*) * any_value(idf) AS w FROM (SELECT doc_id, sent_pos, token AS term FROM sent_tokens) JOIN idf USING (term) GROUP BY doc_id, sent_pos, term),
snorm AS (SELECT doc_id, sent_pos, sqrt(sum(w * w)) AS norm FROM stf GROUP BY 1, 2),
sims AS (SELECT s.doc_id, s.sent_pos, x.topic, round(sum(s.w * x.weight) / any_value(n.norm), 10) AS sim
         FROM stf s JOIN wts x USING (term) JOIN snorm n USING (doc_id, sent_pos) GROUP BY s.doc_id, s.sent_pos, x.topic)
"""
_DENSE = S.with_ctes(["sent_tokens", "word_vectors", "bag_vectors", "sentences"]).rstrip() + """,
sv AS (SELECT t.doc_id, t.sent_pos, i, avg(x) AS x FROM (SELECT t.doc_id, t.sent_pos, unnest(w.vector::DOUBLE[]) AS x,
         generate_subscripts(w.vector, 1) AS i FROM sent_tokens t JOIN word_vectors w USING (token)) t GROUP BY 1, 2, 3),
bu AS (SELECT topic, unnest(vector::DOUBLE[]) / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS x,
         generate_subscripts(vector, 1) AS i FROM bag_vectors),
ce AS (SELECT topic, i, avg(x) AS x FROM bu GROUP BY 1, 2),
cn AS (SELECT topic, sqrt(sum(x * x)) AS n FROM ce GROUP BY 1),
sn AS (SELECT doc_id, sent_pos, sqrt(sum(x * x)) AS n FROM sv GROUP BY 1, 2),
sims AS (SELECT sv.doc_id, sv.sent_pos, ce.topic, round(sum(sv.x * ce.x) / (any_value(sn.n) * any_value(cn.n)), 10) AS sim
         FROM sv JOIN ce USING (i) JOIN sn USING (doc_id, sent_pos) JOIN cn USING (topic) GROUP BY 1, 2, 3)
"""


def _tag_sql(score_rel, score_col, thresh):
    return f"""SELECT s.doc_id, s.sent_pos::BIGINT AS sent_pos, coalesce(array_to_string(h.tags, ','), '-1') AS tags FROM sentences s
LEFT JOIN (SELECT doc_id, sent_pos, list_sort(list(topic)) AS tags FROM {score_rel} WHERE {score_col} > {thresh} GROUP BY 1, 2) h
USING (doc_id, sent_pos)"""


@register("maxsim_topic_scores", _MAXSIM + f"SELECT doc_id, sent_pos::BIGINT AS sent_pos, topic, {S.round6('score')} AS score FROM sc")
def maxsim_topic_scores(spark, sf_dir):
    """A11 + V7: per (sentence, topic), sum over token occurrences of max cosine to the bag (> match)."""
    _, sc = maxsim_scores(spark, sf_dir)
    return sc.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), "topic",
                     round6(F.col("score")).alias("score"))


@register("maxsim_topic_tags", _MAXSIM + _tag_sql("sc", "score", MAXSIM_TAG))
def maxsim_topic_tags(spark, sf_dir):
    """V1: MaxSim keyword tagger — topics with score > thresh, else -1; every sentence kept."""
    sent, sc = maxsim_scores(spark, sf_dir)
    return _tags_out(TG.tags_from_scores(sent.select(*KEYS), sc, KEYS, MAXSIM_TAG))


_BAGS = S.with_ctes(["sent_tokens", "lex_trim", "lemmas", "sentences"]).rstrip() + f""",
bw AS (SELECT DISTINCT b.topic, coalesce(l.lemma, b.t) AS token FROM (SELECT topic_num AS topic, unnest({S.raw_tokens('keyword')}) AS t FROM lex_trim) b
       LEFT JOIN lemmas l ON b.t = l.word),
av AS (SELECT token, e.embedding::DOUBLE[] AS v, sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS n FROM
       (SELECT token, {S.md5_int('token')} % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT token FROM sent_tokens UNION SELECT token FROM bw))
       JOIN embeddings e USING (vec_id)),
tt AS (SELECT w.token, bw.topic, max(round(list_dot_product(w.v, b.v) / (w.n * b.n), 10)) AS maxsim FROM (SELECT DISTINCT token FROM sent_tokens) s
       JOIN av w USING (token), bw JOIN av b ON bw.token = b.token GROUP BY 1, 2
       HAVING max(round(list_dot_product(w.v, b.v) / (w.n * b.n), 10)) > {BAG_MATCH}),
sc AS (SELECT t.doc_id, t.sent_pos, tt.topic, sum(tt.maxsim) AS score FROM sent_tokens t JOIN tt USING (token) GROUP BY 1, 2, 3),
tp AS (SELECT DISTINCT topic_num AS topic FROM lex_trim)
"""


@register("maxsim_word_bags", _BAGS + f"""
SELECT doc_id, sent_pos::BIGINT AS sent_pos, array_to_string(list(topic ORDER BY topic) FILTER (WHERE score > {BAG_TAG}), ',') AS tags,
       list(round(coalesce(score, 0)::DECIMAL(38,10), 6)::DOUBLE ORDER BY topic) AS scores
FROM (SELECT s.doc_id, s.sent_pos, tp.topic, sc.score FROM sentences s CROSS JOIN tp LEFT JOIN sc USING (doc_id, sent_pos, topic)) GROUP BY 1, 2""")
def maxsim_word_bags(spark, sf_dir):
    """V1 + V7: MaxSim against bags of words (the trimmed lexicon): every topic's score for every sentence, and the topics
    above the threshold."""
    t = Tables(spark, sf_dir)
    sent = R.filing_sentences(t).select(*KEYS, "sentence")
    lex = stage(spark, LX.trim(R.topic_lexicon(t, spark)).select("topic_num", "keyword"), "lexicon")
    topics = F.array(*[F.lit(r[0]) for r in lex.select("topic_num").distinct().orderBy("topic_num").collect()])
    tag = PR.make_word_bag_tagger(lex, lambda tokens: R.word_vectors(tokens, t.embeddings), BAG_MATCH,
                                  stopwords=R.stopwords_df(spark), lemmas=R.lemmas_df(spark))
    out = tag(sent, KEYS, return_all_scores=True)
    hit = F.filter(F.transform("scores", lambda x, i: F.when(x > BAG_TAG, F.get(topics, i))), lambda x: x.isNotNull())
    return out.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"),
                      F.when(F.size(hit) > 0, F.array_join(hit, ",")).alias("tags"), F.transform("scores", round6).alias("scores"))


@register("tfidf_weights", _TFIDF + f"SELECT topic, term, {S.round6('weight')} AS weight FROM wts")
def tfidf_weights(spark, sf_dir):
    """Bag TF-IDF weights (smooth idf with +1, L2 norm per bag)."""
    w, _ = tfidf_parts(spark, Tables(spark, sf_dir))
    return w.select("topic", "term", round6(F.col("weight")).alias("weight"))


@register("tfidf_topic_tags", _TFIDF + _tag_sql("sims", "sim", C.TFIDF_TAG_DEFAULT))
def tfidf_topic_tags(spark, sf_dir):
    """V2 + J11: TF-IDF cosine tagger, thresh 0.3, -1 when nothing passes (sparse join on term)."""
    sent, sims = tfidf_sims(spark, sf_dir)
    return _tags_out(TG.tags_from_scores(sent.select(*KEYS), sims, KEYS, C.TFIDF_TAG_DEFAULT, "sim"))


@register("tfidf_argmax_tags", _TFIDF + f"""
, best AS (SELECT doc_id, sent_pos, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY sim DESC, topic ASC) AS rn FROM sims) WHERE rn = 1),
hit AS (SELECT doc_id, sent_pos, list_sort(list(topic)) AS tags FROM sims WHERE sim > {C.TFIDF_ARGMAX_TAG_DEFAULT} GROUP BY 1, 2)
SELECT s.doc_id, s.sent_pos::BIGINT AS sent_pos,
       coalesce(array_to_string(h.tags, ','), CAST(b.topic AS VARCHAR), '0') AS tags
FROM sentences s LEFT JOIN hit h USING (doc_id, sent_pos) LEFT JOIN best b USING (doc_id, sent_pos)""".replace("\n, best", ",\nbest", 1))
def tfidf_argmax_tags(spark, sf_dir):
    """Threshold 0.1, else the argmax topic (all-zero scores → first topic, Q6)."""
    sent, sims = tfidf_sims(spark, sf_dir)
    tagged = TG.tags_from_scores(sent.select(*KEYS), sims, KEYS, C.TFIDF_ARGMAX_TAG_DEFAULT, "sim")
    best = TG.argmax_topic(sims, KEYS).select(*KEYS, F.col("topic").alias("_best"))
    out = tagged.join(best, KEYS, "left")
    fallback = F.array(F.coalesce(F.col("_best"), F.lit(0)))
    out = out.withColumn("topic_ids", F.when(F.col("topic_ids")[0] == C.NULL_TOPIC, fallback).otherwise(F.col("topic_ids")))
    return _tags_out(out)


@register("firm_year_tfidf_distribution", _TFIDF.rstrip() + f""",
pick AS (SELECT doc_id, sent_pos, list_sort(list(topic) FILTER (WHERE sim > {C.TFIDF_ARGMAX_TAG_DEFAULT})) AS above,
         list(topic ORDER BY sim DESC, topic)[1] AS best FROM sims GROUP BY 1, 2),
tfidf_tagged AS (SELECT s.symbol, s.filing_time, s.is_active, s.is_action,
         CASE WHEN len(p.above) > 0 THEN p.above ELSE [coalesce(p.best, 0)] END AS topic_ids
         FROM sentences s LEFT JOIN pick p USING (doc_id, sent_pos))
""" + firm_year_select("tfidf_tagged"))
def firm_year_tfidf_distribution(spark, sf_dir):
    """PL4 on the TF-IDF tagger: topics above the threshold, else the best one, counted per firm-year. The text becomes
    words once, in a staged table that tags and attributes both come from; labels meet rows without text or words."""
    t = Tables(spark, sf_dir)
    sent = TX.voice(TX.sentences(TX.normalize(R.filings(t)), ["doc_id", "symbol", "filing_time"]))
    rows = stage(spark, sent.select(*KEYS, "symbol", "filing_time", "is_active", FT.raw_tokens(F.col("sentence")).alias("words")), "sentence_words")
    toks = TX.lemmatize(rows.select(*KEYS, F.explode("words").alias("token")), R.lemmas_df(spark))
    w, idf = tfidf_parts(spark, t)
    sims = TG.tfidf_sentence_cosine(TX.remove_stopwords(toks, R.stopwords_df(spark)), w, idf, KEYS)
    tagged = TG.argmax_tags(rows.drop("words"), sims, KEYS, C.TFIDF_ARGMAX_TAG_DEFAULT)
    flagged = tagged.join(R.doc_labels(t).select("doc_id", "is_action"), "doc_id", "left")
    return ST.firm_year_topic_distribution(flagged.withColumn("is_action", F.coalesce("is_action", F.lit(False))), TOPICS)


@register("argmax_topic", _TFIDF + f"""
SELECT doc_id, sent_pos::BIGINT AS sent_pos, topic, {S.round6('sim')} AS sim FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY sim DESC, topic ASC) AS rn FROM sims) WHERE rn = 1""")
def argmax_topic(spark, sf_dir):
    """Best topic per sentence by TF-IDF cosine, lowest topic id on ties."""
    _, sims = tfidf_sims(spark, sf_dir)
    best = TG.argmax_topic(sims, KEYS)
    return best.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), "topic", round6(F.col("sim")).alias("sim"))


@register("dense_topic_tags", _DENSE + _tag_sql("sims", "sim", DENSE_TAG))
def dense_topic_tags(spark, sf_dir):
    """V4: dense cosine tagger (sentence vector vs. topic vectors), thresh 0.3, else -1."""
    sent, sims = dense_sims(spark, sf_dir, above=DENSE_TAG)
    return _tags_out(TG.tags_from_scores(sent.select(*KEYS), sims, KEYS, DENSE_TAG, "sim"))


@register("top5_topics", _DENSE + f"""
, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY sim DESC, topic ASC) AS rn FROM sims) WHERE rn <= {TOP_K})
""".replace("\n, top", ",\ntop", 1) + _tag_sql("top", "sim", DENSE_TAG))
def top5_topics(spark, sf_dir):
    """V5 + L6: the 5 nearest topics per sentence, kept when cosine > thresh, else -1."""
    sent, sims = dense_sims(spark, sf_dir, above=DENSE_TAG)
    top = TG.top_k_topics(sims, KEYS, TOP_K, DENSE_TAG)
    return _tags_out(TG.tags_from_scores(sent.select(*KEYS), top, KEYS, DENSE_TAG, "sim"))


@register("cosine_pairs", f"""
WITH u AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x,
                  generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT e.vec_id, e.label, {S.round6('sum(e.x * c.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.x * c.x)))')} AS cosine
FROM e JOIN c USING (label, i) GROUP BY e.vec_id, e.label""")
def cosine_pairs(spark, sf_dir):
    """M2 + A15: cosine of every vector to its label centroid (JVM-side dot/norm on arrays)."""
    emb = Tables(spark, sf_dir).embeddings
    cents = TG.centroids(emb, "label", "embedding")
    j = emb.join(cents, "label")
    return j.select("vec_id", "label", round6(V.cosine(F.col("embedding"), F.col("centroid"))).alias("cosine"))
