"""Text pipeline queries: normalise, sentences, tokens, tags and the firm-year distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import text as FT
from riskweave.operators import lexicon as LX
from riskweave.operators import stats as ST
from riskweave.operators import text as TX
from riskweave.plans import roles as R
from riskweave.plans import sqlfrag as S
from riskweave.plans.registry import register
from riskweave.sources.tables import Tables

TOPICS = list(range(R.N_TOPICS))


def tagged_filing_sentences(spark, sf_dir, with_text: bool = False, with_noise: bool = False):
    """Filing sentences tagged by keyword match against the trimmed lexicon."""
    t = Tables(spark, sf_dir)
    sent = R.filing_sentences(t)
    lex = LX.trim(R.topic_lexicon(t, spark))
    carry = ["symbol", "filing_time", "is_active", "is_action", "is_noise"] + (["p_noise"] if with_noise else [])
    tagged = LX.tag_by_keywords(sent, ["doc_id", "sent_pos"], lex, R.stopwords_df(spark),
                                R.lemmas_df(spark), carry=carry)
    if with_text:
        tagged = tagged.join(sent.select("doc_id", "sent_pos", "sentence"), ["doc_id", "sent_pos"])
    return tagged


@register("normalize_text", S.with_ctes([]) + f"SELECT doc_id, {S.norm('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    """ASCII fold, e-mail and URL removal, character whitelist."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return TX.normalize(d)


@register("tokenize_counts",
          f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({S.raw_tokens('text')}) AS token FROM documents) GROUP BY token")
def tokenize_counts(spark, sf_dir):
    """T2 on raw documents: occurrences per token (letter runs, 3..15 chars)."""
    d = Tables(spark, sf_dir).documents
    return (TX.tokens(d, ["doc_id"]).groupBy("token").agg(F.count("*").cast("long").alias("n")))


@register("sentences", S.with_ctes(["sentences"]) +
          f"SELECT doc_id, sent_pos::BIGINT AS sent_pos, sentence, {S.word_count('sentence')}::BIGINT AS n_words FROM sentences")
def sentences(spark, sf_dir):
    """T4: sentences of normalised filings with at least 5 whitespace tokens."""
    f = TX.normalize(R.filings(Tables(spark, sf_dir)))
    s = TX.sentences(f, ["doc_id"])
    return s.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), "sentence",
                    FT.word_count(F.col("sentence")).cast("long").alias("n_words"))


@register("flatten_sentences", S.with_ctes(["filings"]) + f"""
SELECT d.doc_id, count(x.doc_id)::BIGINT AS n_sentences, max(pos)::BIGINT AS last_pos FROM documents d LEFT JOIN (SELECT * FROM (
  SELECT doc_id, unnest(flat) AS sentence, generate_subscripts(flat, 1) - 1 AS pos FROM (
    SELECT doc_id, flatten(list_transform(regexp_split_to_array(text, '\\.\\n'),
                                          lambda p: {S.sentence_parts('p')})) AS flat FROM filings))
WHERE {S.word_count('sentence')} >= 5) x ON d.doc_id = x.doc_id GROUP BY d.doc_id""")
def flatten_sentences(spark, sf_dir):
    """Paragraph × sentence nesting (array<array<string>>) flattened to one ordered list; a
    filing without sentences counts 0."""
    f = TX.normalize(R.filings(Tables(spark, sf_dir)))
    nested = f.select("doc_id", F.transform(F.split("text", r"\.\n", -1), FT.sentence_pieces).alias("nested"))
    # Counted inside the row: no explode, no shuffle.
    marked = F.transform(F.flatten("nested"), lambda s, i: F.when(FT.word_count(s) >= 5, i))
    at = nested.select("doc_id", F.filter(marked, lambda i: i.isNotNull()).alias("at"))
    return at.select("doc_id", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_sentences"),
                     F.array_max("at").cast("long").alias("last_pos"))


@register("stopword_removed_counts", S.with_ctes(["doc_norm", "stopwords", "lemmas"]) + f"""
SELECT doc_id, count(*)::BIGINT AS n_tokens,
       count(*) FILTER (WHERE token NOT IN (SELECT word FROM stopwords))::BIGINT AS n_content_tokens
FROM (SELECT doc_id, unnest({S.raw_tokens('text')}) AS token FROM doc_norm) GROUP BY doc_id""")
def stopword_removed_counts(spark, sf_dir):
    """Tokens per document before and after the stopword anti join."""
    d = TX.normalize(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    toks = TX.tokens(d, ["doc_id"], keep_position=True)
    kept = TX.remove_stopwords(toks, R.stopwords_df(spark))
    a = toks.groupBy("doc_id").agg(F.count("*").cast("long").alias("n_tokens"))
    b = kept.groupBy("doc_id").agg(F.count("*").cast("long").alias("n_content_tokens"))
    return a.join(b, "doc_id", "left").select("doc_id", "n_tokens",
                                              F.coalesce("n_content_tokens", F.lit(0)).cast("long").alias("n_content_tokens"))


@register("lemma_lookup", S.with_ctes(["doc_norm", "lemmas"]) + f"""
SELECT coalesce(l.lemma, r.token) AS token, count(*)::BIGINT AS n
FROM (SELECT unnest({S.raw_tokens('text')}) AS token FROM doc_norm) r LEFT JOIN lemmas l ON r.token = l.word
GROUP BY 1""")
def lemma_lookup(spark, sf_dir):
    """Token counts after mapping words through the lemma dictionary (identity when absent)."""
    d = TX.normalize(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    toks = TX.tokens(d, ["doc_id"], lemmas=R.lemmas_df(spark))
    return toks.groupBy("token").agg(F.count("*").cast("long").alias("n"))


@register("in_vocab_tokens", S.with_ctes(["sent_tokens", "lex_trim"]) + """
SELECT token, count(*)::BIGINT AS n FROM sent_tokens
WHERE token IN (SELECT keyword FROM lex_trim) GROUP BY token""")
def in_vocab_tokens(spark, sf_dir):
    """Sentence tokens that are in the (trimmed) topic vocabulary — broadcast semi join."""
    t = Tables(spark, sf_dir)
    sent = R.filing_sentences(t)
    toks = TX.tokens(sent, ["doc_id", "sent_pos"], text_col="sentence",
                     stopwords=R.stopwords_df(spark), lemmas=R.lemmas_df(spark))
    vocab = LX.trim(R.topic_lexicon(t, spark)).select(F.col("keyword").alias("token"))
    return (toks.join(F.broadcast(vocab), "token", "left_semi")
            .groupBy("token").agg(F.count("*").cast("long").alias("n")))


@register("voice_flag", S.with_ctes(["sentences"]) + """
SELECT symbol, count(*)::BIGINT AS n_sentences, count_if(is_active)::BIGINT AS n_active,
       count_if(NOT is_active)::BIGINT AS n_passive FROM sentences GROUP BY symbol""")
def voice_flag(spark, sf_dir):
    """active/passive voice by surface pattern, counted per firm."""
    s = R.filing_sentences(Tables(spark, sf_dir))
    return s.groupBy("symbol").agg(F.count("*").cast("long").alias("n_sentences"),
                                   F.count_if("is_active").cast("long").alias("n_active"),
                                   F.count_if(~F.col("is_active")).cast("long").alias("n_passive"))


@register("paragraphs", S.with_ctes(["filings"]) + """
SELECT doc_id, count(*)::BIGINT AS n_paragraphs, sum(length(paragraph))::BIGINT AS n_chars FROM (
  SELECT doc_id, regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '\\.$', '') || '.' AS paragraph
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\.\\n')) AS p FROM filings)) GROUP BY doc_id""")
def paragraphs(spark, sf_dir):
    """T5: paragraphs split on '.\\n', whitespace collapsed, one final '.'."""
    f = TX.normalize(R.filings(Tables(spark, sf_dir)))
    p = TX.paragraphs(f, ["doc_id"])
    return p.groupBy("doc_id").agg(F.count("*").cast("long").alias("n_paragraphs"),
                                   F.sum(F.length("paragraph")).cast("long").alias("n_chars"))


@register("short_paragraphs", S.with_ctes(["filings"]) + """
SELECT DISTINCT paragraph FROM (
  SELECT regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '\\.$', '') || '.' AS paragraph
  FROM (SELECT unnest(regexp_split_to_array(text, '\\.\\n')) AS p FROM filings))
WHERE len(regexp_extract_all(paragraph, '\\S+')) <= 128""")
def short_paragraphs(spark, sf_dir):
    """P12 + A5: unique paragraphs of at most 128 words (input to topic discovery)."""
    f = TX.normalize(R.filings(Tables(spark, sf_dir)))
    p = TX.paragraphs(f, ["doc_id"])
    return p.where(FT.word_count(F.col("paragraph")) <= 128).select("paragraph").distinct()


@register("content_chunks", S.with_ctes(["filings", "stopwords"]).rstrip() + f""",
tk AS (SELECT doc_id, para, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (
       SELECT doc_id, para, {S.raw_tokens("regexp_replace(p, '\\s+', ' ', 'g')")} AS t FROM (
       SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS para FROM (
       SELECT doc_id, regexp_split_to_array(text, '\\.\\n') AS ps FROM filings)))),
m AS (SELECT doc_id, para, i, CASE WHEN token NOT IN (SELECT word FROM stopwords) THEN token END AS a FROM tk),
n AS (SELECT doc_id, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM m WINDOW w AS (PARTITION BY doc_id, para ORDER BY i)),
g AS (SELECT doc_id, a || ' ' || b AS chunk, 2 AS k FROM n WHERE a IS NOT NULL AND b IS NOT NULL
      UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c, 3 FROM n WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT d.doc_id, count(g.chunk)::BIGINT AS n_chunks, coalesce(count_if(k = 3), 0)::BIGINT AS n_trigrams, count(DISTINCT g.chunk)::BIGINT AS n_distinct,
       md5(coalesce(string_agg(DISTINCT g.chunk, ',' ORDER BY g.chunk), '')) AS chunks_md5
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id""")
def content_chunks(spark, sf_dir):
    """Chunks of two and three content words per filing (within paragraphs): occurrences, distinct ones, fingerprint."""
    t = Tables(spark, sf_dir)
    chunks = TX.content_chunks(TX.paragraphs(TX.normalize(R.filings(t)), ["doc_id"]), ["doc_id"])
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.size(F.split("chunk", " ")) == 3).alias("n_trigrams"),
                                       F.array_sort(F.collect_set("chunk")).alias("_set"))
    out = t.documents.select("doc_id").join(per, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("doc_id", n("n_chunks").alias("n_chunks"), n("n_trigrams").alias("n_trigrams"),
                      n(F.when(F.col("_set").isNotNull(), F.size("_set"))).alias("n_distinct"),
                      F.md5(F.coalesce(F.array_join("_set", ","), F.lit(""))).alias("chunks_md5"))


@register("sentence_totals", S.with_ctes(["sentences"]) + """
SELECT symbol, filing_time, count(*)::BIGINT AS total_risk_sentence_count,
       count_if(is_active)::BIGINT AS total_active_sentence_count,
       count_if(is_action)::BIGINT AS total_action_sentence_count
FROM sentences GROUP BY symbol, filing_time""")
def sentence_totals(spark, sf_dir):
    """A1: sentence counts per firm-year, all / active / action, one pass."""
    return ST.sentence_totals(R.filing_sentences(Tables(spark, sf_dir)))


def _pivot_sql():
    cols = ", ".join(f"count_if(topic = {t})::BIGINT AS topic_reduced_{t}" for t in TOPICS)
    return S.with_ctes(["tagged"]) + f"""
SELECT symbol, filing_time, {cols} FROM (SELECT symbol, filing_time, unnest(topic_ids) AS topic FROM tagged)
GROUP BY symbol, filing_time"""


@register("topic_pivot", _pivot_sql())
def topic_pivot(spark, sf_dir):
    """A2: explode topic tags, count per (firm, time, topic), pivot on the fixed topic list."""
    return ST.topic_pivot(tagged_filing_sentences(spark, sf_dir), TOPICS)


def firm_year_select(rel):
    """SQL of the firm-year columns over a relation of tagged sentences."""
    parts = ["count(*)::BIGINT AS total_risk_sentence_count"]
    parts += [f"count_if(list_contains(topic_ids, {t}))::BIGINT AS topic_reduced_{t}" for t in TOPICS]
    parts += ["count_if(is_active)::BIGINT AS total_active_sentence_count"]
    parts += [f"count_if(is_active AND list_contains(topic_ids, {t}))::BIGINT AS topic_reduced_active_{t}" for t in TOPICS]
    parts += ["count_if(is_action)::BIGINT AS total_action_sentence_count"]
    parts += [f"count_if(is_action AND list_contains(topic_ids, {t}))::BIGINT AS topic_reduced_action_{t}" for t in TOPICS]
    return f"SELECT symbol, filing_time, {', '.join(parts)} FROM {rel} GROUP BY symbol, filing_time"


@register("firm_year_topic_distribution", S.with_ctes(["tagged"]) + firm_year_select("tagged"))
def firm_year_topic_distribution(spark, sf_dir):
    """J4 flagship: documents → sentences → tokens → lexicon tags → firm-year topic counts."""
    return ST.firm_year_topic_distribution(tagged_filing_sentences(spark, sf_dir), TOPICS)
