"""Utterance and filing statistics from sentence attributes: given scores (with SQL), and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.functions import text as FT
from riskweave.operators import attributes as AT
from riskweave.operators import lexicon as LX
from riskweave.operators import ml as ML
from riskweave.operators import predictors as PR
from riskweave.operators import text as TX
from riskweave.plans import roles as R
from riskweave.plans import sqlfrag as S
from riskweave.plans.q_relational import EXEC_SPEAKER
from riskweave.plans.q_tagging import MAXSIM_MATCH, MAXSIM_TAG
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import Tables

KEYS = ["transcript_id", "component_order", "sent_pos"]
UTTERANCE = KEYS[:2]
LONG_TOKEN = 6
TOPICS = {"cluster": R.LABEL_CLUSTERS, "pillar": R.PILLARS}


def noise():
    return F.col("p_noise") >= C.CLASSIFIER_THRESH


def action():
    return F.col("p_action") >= C.CLASSIFIER_THRESH


def executive_sentences(t: Tables):
    """Sentences of executives' utterances, ids kept."""
    tr = TX.normalize(R.transcripts(t).where(F.col("speaker_type") == EXEC_SPEAKER))
    return TX.sentences(tr, UTTERANCE)


def executive_utterances(t: Tables):
    return R.transcripts(t).where(F.col("speaker_type") == EXEC_SPEAKER).select(*UTTERANCE)


def given_scores():
    """Scores that stand for a model's probabilities: the share of stopwords, and of long words, among the tokens."""
    tokens = FT.raw_tokens(F.col("sentence"))
    long = F.size(F.filter(tokens, lambda x: F.length(x) >= LONG_TOKEN)) / F.size(tokens)
    return {"noise": lambda df: df.withColumn("p_noise", F.round(FT.stopword_share(F.col("sentence")), 6)),
            "action": lambda df: df.withColumn("p_action", F.round(F.when(F.size(tokens) > 0, long).otherwise(0.0), 6))}


def bag_taggers(spark, t: Tables):
    """MaxSim against a bag per label, and per pillar (labels in turn)."""
    bags = stage(spark, R.bag_vectors(t.embeddings), "bags")  # a few vectors per label, read by both taggers

    def maxsim(bag):
        tag = PR.make_maxsim_tagger(bag, lambda tokens: R.word_vectors(tokens, t.embeddings), MAXSIM_MATCH,
                                    R.stopwords_df(spark), R.lemmas_df(spark))
        return lambda df, keys, text_col: tag(df, keys, text_col, thresh=MAXSIM_TAG)

    return {"cluster": maxsim(bags), "pillar": maxsim(bags.withColumn("topic", F.col("topic") % R.N_PILLARS))}


def utterance_attributes(spark, t: Tables, scorers):
    return AT.sentence_attributes(spark, executive_sentences(t), KEYS, bag_taggers(spark, t), scorers)


def _attributes_sql():
    """The attribute table: sentences of executives with both scores and both tag lists."""
    k = ", ".join(KEYS)
    tok = S.raw_tokens("sentence")

    def tags(kind, topic):
        return [(f"tt_{kind}", f"SELECT w.token, {topic} AS topic, max(round(list_dot_product(w.v, b.v) / (w.n * b.n), 10)) AS m FROM uwv w, ubv b "
                               f"GROUP BY 1, 2 HAVING max(round(list_dot_product(w.v, b.v) / (w.n * b.n), 10)) > {MAXSIM_MATCH}"),
                (f"tag_{kind}", f"SELECT {k}, list_sort(list(topic)) AS ids FROM (SELECT {k}, topic, sum(m) AS score FROM utok "
                                f"JOIN tt_{kind} USING (token) GROUP BY {k}, topic) WHERE score > {MAXSIM_TAG} GROUP BY {k}")]

    unit = "sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]))"
    extra = [("usent", f"SELECT *, round({S.stopword_share('sentence')}, 6) AS p_noise, CASE WHEN len({tok}) > 0 THEN "
                       f"round(len(list_filter({tok}, lambda x: length(x) >= {LONG_TOKEN})) / len({tok}), 6) ELSE 0.0 END AS p_action "
                       f"FROM (SELECT transcript_id, component_order, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS sent_pos FROM "
                       f"(SELECT transcript_id, component_order, {S.sentence_parts(S.norm('text'))} AS parts FROM transcripts "
                       f"WHERE speaker_type = {S.lit(EXEC_SPEAKER)})) WHERE {S.word_count('sentence')} >= {C.SENTENCE_MIN_TOKENS}"),
             ("utok", f"SELECT {k}, coalesce(l.lemma, r.token) AS token FROM (SELECT {k}, unnest({tok}) AS token FROM usent) r "
                      "LEFT JOIN lemmas l ON r.token = l.word WHERE coalesce(l.lemma, r.token) NOT IN (SELECT word FROM stopwords)"),
             ("uwv", f"SELECT token, embedding::DOUBLE[] AS v, {unit.format('embedding')} AS n FROM (SELECT DISTINCT token, {S.md5_int('token')} % "
                     "(SELECT count(*) FROM embeddings) AS vec_id FROM utok) JOIN embeddings USING (vec_id)"),
             ("ubv", f"SELECT topic, vector::DOUBLE[] AS v, {unit.format('vector')} AS n FROM bag_vectors"),
             *tags("cluster", "b.topic"), *tags("pillar", f"b.topic % {R.N_PILLARS}"),
             ("att", f"SELECT s.*, coalesce(c.ids, [-1]) AS cluster, coalesce(p.ids, [-1]) AS pillar FROM usent s "
                     f"LEFT JOIN tag_cluster c USING ({k}) LEFT JOIN tag_pillar p USING ({k})")]
    return S.with_ctes(["transcripts", "lemmas", "stopwords", "bag_vectors"], extra)


def _statistics_sql():
    cols, totals = ["count(*)::BIGINT AS n_sentences", "count_if(p_action >= 0.5)::BIGINT AS n_actions"], []
    for kind, names in TOPICS.items():
        for i, n in enumerate(names):
            cols += [f"count_if(list_contains({kind}, {i}))::BIGINT AS n_sentences_topic_{kind}_{n}",
                     f"count_if(p_action >= 0.5 AND list_contains({kind}, {i}))::BIGINT AS n_actions_topic_{kind}_{n}"]
        for what in ("sentences", "actions"):
            totals.append(" + ".join(f"n_{what}_topic_{kind}_{n}" for n in names) + f" AS n_{what}_topic_{kind}_total")
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    return _attributes_sql() + f"""SELECT *, {', '.join(totals)} FROM (
  SELECT transcript_id, component_order, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)}
  FROM (SELECT transcript_id, component_order FROM transcripts WHERE speaker_type = {S.lit(EXEC_SPEAKER)}) u
  LEFT JOIN (SELECT transcript_id, component_order, {', '.join(cols)} FROM att WHERE p_noise < 0.5 GROUP BY 1, 2) a
  USING (transcript_id, component_order))"""


def _named_sql(kind):
    names = "[" + ", ".join(S.lit(n) for n in TOPICS[kind]) + "]"
    return f"array_to_string(list_transform({kind}, lambda i: CASE WHEN i >= 0 THEN {names}[i + 1] ELSE 'null' END), ', ')"


@register("utterance_statistics", _statistics_sql())
def utterance_statistics(spark, sf_dir):
    """PL6: per executive utterance, sentences and actions (p >= 0.5) in all and per cluster and pillar topic; noise
    sentences (p >= 0.5) count nowhere, every utterance has its row."""
    t = Tables(spark, sf_dir)
    return AT.topic_statistics(utterance_attributes(spark, t, given_scores()), UTTERANCE, TOPICS, executive_utterances(t), action(), noise())


@register("utterance_sentences", _attributes_sql() + f"""
SELECT transcript_id, component_order, sent_pos::BIGINT AS sent_pos, sentence, {_named_sql('cluster')} AS topic_names_cluster,
       {_named_sql('pillar')} AS topic_names_pillar, p_noise, p_action FROM att WHERE p_noise < 0.5""")
def utterance_sentences(spark, sf_dir):
    """PL6: the sentences behind the statistics with topic names and both probabilities, one row each, ids kept."""
    t = Tables(spark, sf_dir)
    att = utterance_attributes(spark, t, given_scores()).withColumn("sent_pos", F.col("sent_pos").cast("long"))
    return AT.sentence_listing(att, KEYS, TOPICS, noise())


def fitted_scorers(spark, t: Tables, labels, max_iter: int = 64):
    """Scorers of pipelines fitted on labelled documents: name → column of labels (1 = yes)."""
    docs = t.documents.select("doc_id", "text")
    out = {}
    for name, col in labels.items():
        rows = docs.join(t.labels.select("doc_id", F.col(col).cast("double").alias("label")).where("label is not null"), "doc_id")
        model = ML.text_classifier(max_iter=max_iter, reg=0.01).fit(TX.normalize(rows))  # only labelled documents are normalised
        out[name] = AT.saved_model_scorer(spark, model, f"p_{name}")
    return out


@register("utterance_statistics_scored")
def utterance_statistics_scored(spark, sf_dir):
    """C3 + PL6: the same statistics with the probabilities of two fitted pipelines (noise, action)."""
    t = Tables(spark, sf_dir)
    att = utterance_attributes(spark, t, fitted_scorers(spark, t, {"noise": "toxic", "action": "quality"}))
    return AT.topic_statistics(att, UTTERANCE, TOPICS, executive_utterances(t), action(), noise())


def scored_filing_attributes(spark, t: Tables, max_iter: int = 64):
    """Attributes of all filing sentences: p_action of a fitted pipeline, cluster and pillar tags by keyword."""
    sent = TX.sentences(TX.normalize(R.filings(t)), ["doc_id"])
    counts = R.lexicon_counts(t, spark)
    taggers = {kind: PR.make_keyword_tagger(LX.trim(R.lexicon_from_counts(counts, names)), R.stopwords_df(spark), R.lemmas_df(spark))
               for kind, names in (("cluster", R.CLUSTERS), ("pillar", R.PILLARS))}
    return AT.sentence_attributes(spark, sent, ["doc_id", "sent_pos"], taggers, fitted_scorers(spark, t, {"action": "quality"}, max_iter))


@register("filing_statistics_scored")
def filing_statistics_scored(spark, sf_dir):
    """C3 → A8: filing statistics whose actions are the sentences that a fitted pipeline gives p >= 0.5."""
    t = Tables(spark, sf_dir)
    every = R.filings(t).select("doc_id", "symbol", "filing_time")
    return AT.topic_statistics(scored_filing_attributes(spark, t), ["doc_id"], {"cluster": R.CLUSTERS, "pillar": R.PILLARS}, every, action())
