"""Statistics queries: per-document / per-component counters, rules, metrics, samples, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.functions import text as FT
from riskweave.functions.misc import round6
from riskweave.operators import lexicon as LX
from riskweave.operators import relational as RL
from riskweave.operators import stats as ST
from riskweave.operators import text as TX
from riskweave.plans import roles as R
from riskweave.plans import sqlfrag as S
from riskweave.plans.q_tagging import tfidf_sims
from riskweave.plans.q_text import TOPICS, tagged_filing_sentences
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import Tables

# Target topic set for overlap filters, pillar id offset, sample / review sizes.
TARGET_TOPICS = (2, 5, 7)
PILLAR_OFFSET = 100
REVIEW_N = 100
SAMPLE_N = 50

CLUSTER_NAMES = list(R.CLUSTERS)
PILLAR_NAMES = list(R.PILLARS)


def both_lexicons(spark, t: Tables):
    """Cluster ∪ pillar lexicons (pillar ids offset by 100), trimmed — one tagging pass for both."""
    cl = LX.trim(R.topic_lexicon(t, spark)).select("topic_num", "keyword")
    pl = LX.trim(R.topic_lexicon(t, spark, R.PILLARS)).select(
        (F.col("topic_num") + PILLAR_OFFSET).alias("topic_num"), "keyword")
    return cl.unionByName(pl)


def doc_topic_statistics_df(spark, sf_dir):
    """A8 + A9: per filing, sentence/action counts overall, per cluster topic and per pillar."""
    t = Tables(spark, sf_dir)
    sent = R.filing_sentences(t)
    tagged = LX.tag_by_keywords(sent, ["doc_id", "sent_pos"], both_lexicons(spark, t), R.stopwords_df(spark),
                                R.lemmas_df(spark), carry=["symbol", "filing_time", "is_action"])
    act = F.col("is_action")
    has = lambda tid: F.array_contains("topic_ids", F.lit(tid))
    aggs = [F.count("*").cast("long").alias("n_sentences"), F.count_if(act).cast("long").alias("n_actions")]
    for kind, names, off in (("cluster", CLUSTER_NAMES, 0), ("pillar", PILLAR_NAMES, PILLAR_OFFSET)):
        for i, name in enumerate(names):
            aggs += [F.count_if(has(off + i)).cast("long").alias(f"n_sentences_topic_{kind}_{name}"),
                     F.count_if(act & has(off + i)).cast("long").alias(f"n_actions_topic_{kind}_{name}")]
    out = tagged.groupBy("doc_id").agg(*aggs)
    # every filing has a row, also one without a sentence
    out = R.filings(t).select("doc_id", "symbol", "filing_time").join(out, "doc_id", "left").fillna(
        0, [c for c in out.columns if c.startswith("n_")])
    for kind, names in (("cluster", CLUSTER_NAMES), ("pillar", PILLAR_NAMES)):
        for what in ("sentences", "actions"):
            total = sum((F.col(f"n_{what}_topic_{kind}_{n}") for n in names), F.lit(0))
            out = out.withColumn(f"n_{what}_topic_{kind}_total", total.cast("long"))
    return out


def _doc_stats_sql():
    extra = [("pillar_counts", S.lex_counts_sql(R.PILLARS)),
             ("pillar", S.lexicon_sql(R.PILLARS, "pillar_counts")),
             ("lex_all", f"SELECT topic_num, keyword FROM lex_trim UNION ALL SELECT topic_num + {PILLAR_OFFSET}, keyword FROM pillar WHERE \"drop\" IS DISTINCT FROM 1"),
             ("hits2", "SELECT DISTINCT t.doc_id, t.sent_pos, x.topic_num AS topic FROM sent_tokens t JOIN lex_all x ON t.token = x.keyword"),
             ("tg", "SELECT s.doc_id, s.sent_pos, s.symbol, s.filing_time, s.is_action, coalesce(h.ids, []) AS ids FROM sentences s "
                    "LEFT JOIN (SELECT doc_id, sent_pos, list(topic) AS ids FROM hits2 GROUP BY 1, 2) h USING (doc_id, sent_pos)")]
    cols = ["count(*)::BIGINT AS n_sentences", "count_if(is_action)::BIGINT AS n_actions"]
    tots = []
    for kind, names, off in (("cluster", CLUSTER_NAMES, 0), ("pillar", PILLAR_NAMES, PILLAR_OFFSET)):
        for i, name in enumerate(names):
            cols += [f"count_if(list_contains(ids, {off + i}))::BIGINT AS n_sentences_topic_{kind}_{name}",
                     f"count_if(is_action AND list_contains(ids, {off + i}))::BIGINT AS n_actions_topic_{kind}_{name}"]
        for what in ("sentences", "actions"):
            tots.append(" + ".join(f"n_{what}_topic_{kind}_{n}" for n in names) + f" AS n_{what}_topic_{kind}_total")
    base = S.with_ctes(["sentences", "sent_tokens", "lex_trim"], extra)
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    full = f"SELECT d.doc_id, d.symbol, d.filing_time, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)} FROM (SELECT doc_id, source AS symbol, {S.FILING_TIME} AS filing_time FROM documents) d LEFT JOIN (SELECT doc_id, {', '.join(cols)} FROM tg GROUP BY 1) g USING (doc_id)"
    return base + f"SELECT *, {', '.join(tots)} FROM ({full})"


@register("doc_topic_statistics", _doc_stats_sql())
def doc_topic_statistics(spark, sf_dir):
    """Filing statistics — conditional counts per topic and pillar in one aggregation."""
    return doc_topic_statistics_df(spark, sf_dir)


def transcript_sentences(spark, t: Tables):
    tr = TX.normalize(R.transcripts(t))
    s = TX.sentences(tr, ["transcript_id", "component_order", "speaker_type"])
    return s.withColumn("p_noise", F.round(FT.stopword_share(F.col("sentence")), 6))


@register("component_counters", S.with_ctes(["transcripts", "lex_trim", "lemmas", "stopwords"]) + f"""
, ts AS (SELECT transcript_id, component_order, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS sent_pos FROM
         (SELECT transcript_id, component_order, {S.sentence_parts(S.norm('text'))} AS parts FROM transcripts)),
s AS (SELECT *, round({S.stopword_share('sentence')}, 6) AS p_noise FROM ts WHERE {S.word_count('sentence')} >= {C.SENTENCE_MIN_TOKENS}),
tok AS (SELECT r.transcript_id, r.component_order, r.sent_pos, coalesce(l.lemma, r.token) AS token
        FROM (SELECT transcript_id, component_order, sent_pos, unnest({S.raw_tokens('sentence')}) AS token FROM s) r
        LEFT JOIN lemmas l ON r.token = l.word WHERE coalesce(l.lemma, r.token) NOT IN (SELECT word FROM stopwords)),
h AS (SELECT DISTINCT t.transcript_id, t.component_order, t.sent_pos, x.topic_num AS topic FROM tok t JOIN lex_trim x ON t.token = x.keyword),
hh AS (SELECT transcript_id, component_order, sent_pos, list(topic) AS ids FROM h GROUP BY 1, 2, 3)
SELECT transcript_id, component_order, count(*)::BIGINT AS n_sentences, count_if(p_noise >= 0.5)::BIGINT AS n_noise,
       {', '.join(f"count_if(list_contains(coalesce(ids, []), {t}))::BIGINT AS n_topic_{t}" for t in TOPICS)}
FROM s LEFT JOIN hh USING (transcript_id, component_order, sent_pos) GROUP BY 1, 2""".replace("\n, ts AS", ",\nts AS", 1))
def component_counters(spark, sf_dir):
    """Per transcript component — sentences, noise sentences (p >= 0.5), sentences per topic."""
    t = Tables(spark, sf_dir)
    s = transcript_sentences(spark, t)
    lex = LX.trim(R.topic_lexicon(t, spark))
    tg = LX.tag_by_keywords(s, ["transcript_id", "component_order", "sent_pos"], lex, R.stopwords_df(spark),
                            R.lemmas_df(spark), carry=["p_noise"])
    aggs = [F.count("*").cast("long").alias("n_sentences"), F.count_if(F.col("p_noise") >= 0.5).cast("long").alias("n_noise")]
    aggs += [F.count_if(F.array_contains("topic_ids", F.lit(x))).cast("long").alias(f"n_topic_{x}") for x in TOPICS]
    return tg.groupBy("transcript_id", "component_order").agg(*aggs)


@register("threshold_label", S.with_ctes(["sentences"]) + """
SELECT d.doc_id, count(s.doc_id)::BIGINT AS n_sentences, coalesce(count_if(p_noise > 0.5), 0)::BIGINT AS n_label_gt,
       coalesce(count_if(p_noise >= 0.5), 0)::BIGINT AS n_label_ge, round(avg(p_noise), 6) AS avg_p
FROM documents d LEFT JOIN sentences s ON d.doc_id = s.doc_id GROUP BY d.doc_id""")
def threshold_label(spark, sf_dir):
    """P13 + Q9: probability → 0/1 with the classifier's strict ``>`` and the statistics' ``>=``."""
    from riskweave.functions.misc import prob_label
    t = Tables(spark, sf_dir)
    s = R.filing_sentences(t)
    per = s.groupBy("doc_id").agg(F.count("*").cast("long").alias("n_sentences"),
                                  F.sum(prob_label(F.col("p_noise"), 0.5)).cast("long").alias("n_label_gt"),
                                  F.count_if(F.col("p_noise") >= 0.5).cast("long").alias("n_label_ge"),
                                  F.round(F.avg("p_noise"), 6).alias("avg_p"))
    return t.documents.select("doc_id").join(per, "doc_id", "left").fillna(0, ["n_sentences", "n_label_gt", "n_label_ge"])


def action_rule_col():
    pos = F.when(F.col("n_tokens") > 0, F.col("n_hit_tokens") / F.col("n_tokens")).otherwise(F.lit(0.0))
    neg = F.col("p_noise")
    return (pos > neg) & (pos > C.ACTION_POS_MIN) & F.col("is_active")


_RULE_SQL = f"""(CASE WHEN n_tokens > 0 THEN n_hit_tokens / n_tokens ELSE 0.0 END > p_noise
  AND CASE WHEN n_tokens > 0 THEN n_hit_tokens / n_tokens ELSE 0.0 END > {C.ACTION_POS_MIN} AND is_active)"""


@register("action_rule", S.with_ctes(["tagged"]) + f"""
SELECT symbol, filing_time, count_if({_RULE_SQL})::BIGINT AS n_rule_actions, count(*)::BIGINT AS n_sentences
FROM tagged GROUP BY 1, 2""")
def action_rule(spark, sf_dir):
    """Composite rule ``pos > neg AND pos > 0.2 AND active voice`` (pos = keyword-hit share,
    neg = noise score), counted per firm-year."""
    tg = tagged_filing_sentences(spark, sf_dir, with_noise=True)
    return tg.groupBy("symbol", "filing_time").agg(F.count_if(action_rule_col()).cast("long").alias("n_rule_actions"),
                                                   F.count("*").cast("long").alias("n_sentences"))


def doc_predictions(spark, sf_dir):
    """Document prediction = has at least one rule-action sentence; truth = labels.quality."""
    t = Tables(spark, sf_dir)
    tg = tagged_filing_sentences(spark, sf_dir, with_noise=True)
    pred = tg.groupBy("doc_id").agg(F.max(action_rule_col().cast("int")).alias("pred"))
    return t.labels.select("doc_id", F.col("quality").alias("truth")).join(pred, "doc_id", "left") \
        .select("doc_id", "truth", F.coalesce("pred", F.lit(0)).alias("pred"))


_PRED_SQL = S.with_ctes(["tagged"]) + f"""
, pr AS (SELECT l.doc_id, l.quality AS truth, coalesce(p.pred, 0) AS pred FROM labels l LEFT JOIN
        (SELECT doc_id, max(CASE WHEN {_RULE_SQL} THEN 1 ELSE 0 END) AS pred FROM tagged GROUP BY doc_id) p USING (doc_id))
""".replace("\n, pr AS", ",\npr AS", 1)


@register("binary_metrics", _PRED_SQL + """
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
       round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM (SELECT count_if(pred = 1 AND truth = 1) AS tp, count_if(pred = 1 AND truth = 0) AS fp,
             count_if(pred = 0 AND truth = 1) AS fn, count_if(pred = 0 AND truth = 0) AS tn FROM pr)""")
def binary_metrics(spark, sf_dir):
    """Accuracy, precision, recall, F1 from one aggregate of tp/fp/fn/tn."""
    return ST.binary_metrics(doc_predictions(spark, sf_dir), "truth", "pred")


@register("confusion_matrix", _PRED_SQL + "SELECT truth, pred, count(*)::BIGINT AS n FROM pr GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    """Confusion matrix as (truth, pred, n) group counts."""
    p = doc_predictions(spark, sf_dir)
    return p.groupBy("truth", "pred").agg(F.count("*").cast("long").alias("n"))


@register("misclassified", _PRED_SQL + "SELECT doc_id, truth, pred FROM pr WHERE pred <> truth")
def misclassified(spark, sf_dir):
    """Rows where the prediction differs from the label (error listing)."""
    p = doc_predictions(spark, sf_dir)
    return p.where(F.col("pred") != F.col("truth"))


@register("tags_overlap", S.with_ctes(["tagged"]) + f"""
SELECT symbol, count(*)::BIGINT AS n_overlap FROM tagged WHERE list_has_any(topic_ids, {list(TARGET_TOPICS)}) GROUP BY symbol""")
def tags_overlap(spark, sf_dir):
    """Sentences whose tag set overlaps a target topic set."""
    tg = tagged_filing_sentences(spark, sf_dir)
    target = F.array(*[F.lit(x) for x in TARGET_TOPICS])
    return tg.where(F.arrays_overlap("topic_ids", target)).groupBy("symbol").agg(F.count("*").cast("long").alias("n_overlap"))


@register("zip_explode_sentences", S.with_ctes(["tagged"]) + """
SELECT doc_id, sent_pos::BIGINT AS idx, length(sentence)::BIGINT AS n_chars, array_to_string(topic_ids, ',') AS tags FROM tagged""")
def zip_explode_sentences(spark, sf_dir):
    """Parallel per-document arrays (sentences, tags) zipped positionally back into rows."""
    tg = tagged_filing_sentences(spark, sf_dir, with_text=True)
    per_doc = tg.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_pos", "sentence", "topic_ids"))).alias("s"))
    arrays = per_doc.select("doc_id", F.transform("s", lambda x: x["sent_pos"]).alias("pos"),
                            F.transform("s", lambda x: x["sentence"]).alias("sentences"),
                            F.transform("s", lambda x: x["topic_ids"]).alias("tags"))
    z = arrays.select("doc_id", F.explode(F.arrays_zip("pos", "sentences", "tags")).alias("z"))
    return z.select("doc_id", F.col("z.pos").cast("long").alias("idx"), F.length("z.sentences").cast("long").alias("n_chars"),
                    F.array_join("z.tags", ",").alias("tags"))


@register("review_top_actions", S.with_ctes(["sent_tokens", "lex_trim", "sentences"]).rstrip() + """,
tf_b AS (SELECT DISTINCT topic_num AS topic, keyword AS term FROM lex_trim),
idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT topic) FROM tf_b)) / (1 + count(*))) + 1 AS idf FROM tf_b GROUP BY term),
wts AS (SELECT topic, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY topic)) AS weight FROM tf_b JOIN idf USING (term)),
stf AS (SELECT doc_id, sent_pos, term, count(*) * any_value(idf) AS w FROM (SELECT doc_id, sent_pos, token AS term FROM sent_tokens) JOIN idf USING (term) GROUP BY doc_id, sent_pos, term),
snorm AS (SELECT doc_id, sent_pos, sqrt(sum(w * w)) AS norm FROM stf GROUP BY 1, 2),
sims AS (SELECT s.doc_id, s.sent_pos, x.topic, round(sum(s.w * x.weight) / any_value(n.norm), 10) AS sim
         FROM stf s JOIN wts x USING (term) JOIN snorm n USING (doc_id, sent_pos) GROUP BY s.doc_id, s.sent_pos, x.topic),
best AS (SELECT doc_id, sent_pos, max(sim) AS score FROM sims WHERE sim > 0.3 GROUP BY 1, 2)
SELECT s.doc_id, s.sent_pos::BIGINT AS sent_pos, round((b.score)::DECIMAL(38,10), 6)::DOUBLE AS score, s.sentence FROM best b JOIN sentences s USING (doc_id, sent_pos)
WHERE NOT s.is_noise ORDER BY b.score DESC, s.doc_id, s.sent_pos LIMIT 100""")
def review_top_actions(spark, sf_dir):
    """The 100 highest-scoring tagged, non-noise sentences for review (top-k is the feature)."""
    sent, sims = tfidf_sims(spark, sf_dir)
    best = sims.where(F.col("sim") > C.TFIDF_TAG_DEFAULT).groupBy("doc_id", "sent_pos").agg(F.max("sim").alias("score"))
    j = best.join(sent.where(~F.col("is_noise")).select("doc_id", "sent_pos", "sentence"), ["doc_id", "sent_pos"])
    top = j.orderBy(F.desc("score"), "doc_id", "sent_pos").limit(REVIEW_N)
    return top.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), round6(F.col("score")).alias("score"), "sentence")


@register("tagged_sentence_samples", S.with_ctes(["tagged", "lexicon"]) + f"""
, nm AS (SELECT DISTINCT topic_num, topic_name FROM lexicon),
tn AS (SELECT doc_id, sent_pos, string_agg(nm.topic_name, ', ' ORDER BY x.topic) AS tag_names
       FROM (SELECT doc_id, sent_pos, unnest(topic_ids) AS topic FROM tagged) x JOIN nm ON x.topic = nm.topic_num GROUP BY 1, 2)
SELECT t.doc_id, t.sent_pos::BIGINT AS sent_pos, tn.tag_names, t.sentence FROM tagged t JOIN tn USING (doc_id, sent_pos)
ORDER BY md5(CAST(t.doc_id AS VARCHAR) || '-' || CAST(t.sent_pos AS VARCHAR)) LIMIT {SAMPLE_N}""".replace("\n, nm AS", ",\nnm AS", 1))
def tagged_sentence_samples(spark, sf_dir):
    """Review sample — sentence with comma-joined tag names; untagged sentences dropped. All sentences are tagged, without
    their text; the text is read again for the documents of the sample only."""
    t = Tables(spark, sf_dir)
    lex = stage(spark, R.topic_lexicon(t, spark), "lexicon")
    names = lex.select("topic_num", "topic_name").distinct()
    sent = TX.sentences(TX.normalize(R.filings(t)), ["doc_id"])
    tagged = LX.tag_by_keywords(sent, ["doc_id", "sent_pos"], LX.trim(lex), R.stopwords_df(spark), R.lemmas_df(spark))
    key = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("sent_pos").cast("string"))
    # Every key has a sentence, so that the first SAMPLE_N keys hold the first SAMPLE_N sentences, however often a key occurs.
    some = tagged.where(F.col("doc_id").isNotNull() & (F.col("topic_ids")[0] != C.NULL_TOPIC)).select("doc_id", "sent_pos", "topic_ids")
    some = stage(spark, RL.stable_sample(some, key, SAMPLE_N), "sampled_keys")
    docs = t.documents.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    tg = stage(spark, R.filing_sentences(t, docs).select("doc_id", "sent_pos", "sentence").join(F.broadcast(some), ["doc_id", "sent_pos"]), "sampled_sentences")
    ex = tg.select("doc_id", "sent_pos", F.explode("topic_ids").alias("topic_num"))
    named = ex.join(F.broadcast(names), "topic_num").groupBy("doc_id", "sent_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_num", "topic_name"))), lambda s: s["topic_name"]), ", ").alias("tag_names"))
    j = named.join(tg.select("doc_id", "sent_pos", "sentence"), ["doc_id", "sent_pos"])
    return RL.stable_sample(j, key, SAMPLE_N).select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), "tag_names", "sentence")


def _target_tokens(spark, df, keys):
    """Verb lemmas of all tokens but English stopwords (removed before the lemma is looked up)."""
    verb = R.lemmas_df(spark).where(F.col("pos") == "v")
    sw = spark.createDataFrame([(w,) for w in sorted(set(C.ENGLISH_STOPWORDS))], "word string")
    return TX.lemmatize(TX.tokens(df, keys, stopwords=sw), verb)


@register("target_word_counts", S.with_ctes(["filings"]) + f"""
, vlem AS (SELECT word, lemma FROM {S.values(R.LEMMA_ROWS, ['word', 'pos', 'lemma'])} WHERE pos = 'v'),
esw AS (SELECT * FROM {S.values([(w,) for w in sorted(set(C.ENGLISH_STOPWORDS))], ['word'])}),
bt AS (SELECT DISTINCT coalesce(l.lemma, r.token) AS target FROM (SELECT unnest({S.raw_tokens(S.norm('text'))}) AS token FROM benchmark) r
       LEFT JOIN vlem l ON r.token = l.word WHERE r.token NOT IN (SELECT word FROM esw)),
dt AS (SELECT r.doc_id, coalesce(l.lemma, r.token) AS token FROM (SELECT doc_id, unnest({S.raw_tokens('text')}) AS token FROM filings) r
       LEFT JOIN vlem l ON r.token = l.word WHERE r.token NOT IN (SELECT word FROM esw)),
hit AS (SELECT doc_id, token AS target, count(*) AS n_hits FROM dt WHERE token IN (SELECT target FROM bt) GROUP BY 1, 2),
tot AS (SELECT doc_id, count(*) AS n_tokens, count_if(token IN (SELECT target FROM bt)) AS n_total_hits FROM dt GROUP BY doc_id)
SELECT d.doc_id, hit.target, coalesce(hit.n_hits, 0)::BIGINT AS n_hits, coalesce(tot.n_tokens, 0)::BIGINT AS n_tokens,
       coalesce(tot.n_total_hits, 0)::BIGINT AS n_total_hits
FROM documents d LEFT JOIN hit USING (doc_id) LEFT JOIN tot USING (doc_id)""".replace("\n, vlem AS", ",\nvlem AS", 1))
def target_word_counts(spark, sf_dir):
    """A10 + Q15: per filing, hits of every (de-duplicated) target word by verb lemma, token total
    and total hits; long form (one row per filing and target with hits; a filing without hits has one
    row with a null target)."""
    t = Tables(spark, sf_dir)
    bench = TX.normalize(t.benchmark.select("item_id", "text"))
    targets = _target_tokens(spark, bench, ["item_id"]).select(F.col("token").alias("target")).distinct()
    dt = _target_tokens(spark, TX.normalize(R.filings(t)), ["doc_id"])
    words = dt.groupBy("doc_id", "token").agg(F.count("*").cast("long").alias("n")).join(targets, F.col("token") == F.col("target"), "left")
    per_doc = words.groupBy("doc_id").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("target").isNotNull(), F.col("n")).otherwise(0)).alias("n_total_hits"),
        F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", F.col("n").alias("n_hits")))).alias("_hits"))
    out = t.documents.select("doc_id").join(per_doc, "doc_id", "left")
    return out.select("doc_id", F.explode_outer("_hits").alias("_h"), "n_tokens", "n_total_hits").select(
        "doc_id", F.col("_h.target").alias("target"), F.coalesce("_h.n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("n_total_hits", F.lit(0)).cast("long").alias("n_total_hits"))


@register("clean_strings", "SELECT c_custkey, lower(trim(c_name)) AS c_name, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer")
def clean_strings(spark, sf_dir):
    """Lower-case and strip every string column (one projection)."""
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_mktsegment")
    return c.select(*[F.lower(F.trim(F.col(n))).alias(n) if dt == "string" else F.col(n) for n, dt in c.dtypes])
