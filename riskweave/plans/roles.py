"""Stand-in inputs: the driver tables in the roles the pipeline expects (see FIXTURES.md, part B).

These builders only rename and derive key columns; they do none of the jobs' work. Every
operator downstream is general and does not rely on how these rows were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import constants as C
from riskweave.functions.misc import md5_int
from riskweave.functions.text import stopword_share
from riskweave.operators import text as TX
from riskweave.operators.tagging import KeyedVectors
from riskweave.sources.files import stage
from riskweave.sources.tables import Tables

# The documents → filings role (FIXTURES.md B).
FIRST_FILING_YEAR = 2006
FILING_YEARS = 15
# Word-vector role: a token's vector is the row md5(token) modulo the number of rows of embeddings.
# Topic-bag role: one bag per label, its BAG_SIZE vectors nearest the label's mean (inner product).
BAG_SIZE = 5
# Lexicon role: every source belongs to one of N_TOPICS clusters (and one of N_PILLARS pillars) by its
# hash; a topic's words are the LEXICON_TOP most frequent tokens (length >= LEXICON_MIN_LEN) of its sources.
N_TOPICS = 9
N_PILLARS = 3
LEXICON_TOP = 20
LEXICON_MIN_LEN = 4
SECOND_REVIEW = 7
CLUSTERS = tuple(f"cluster{i}" for i in range(N_TOPICS))
PILLARS = tuple(f"pillar{i}" for i in range(N_PILLARS))
# Bag role: the labels of embeddings as topics.
N_LABELS = 10
LABEL_CLUSTERS = tuple(f"label{i}" for i in range(N_LABELS))
# MaxSim match threshold suited to this vector fixture (API default stays 0.9).
FIXTURE_MATCH_THRESH = 0.25
FIXTURE_MAXSIM_TAG_THRESH = 0.5

# Hand-written lemma dictionary (word, part of speech, lemma).
LEMMA_ROWS = (
    ("mines", "n", "mine"), ("mining", "v", "mine"), ("paid", "v", "pay"), ("risks", "n", "risk"),
    ("companies", "n", "company"), ("operations", "n", "operation"), ("prices", "n", "price"),
    ("costs", "n", "cost"), ("results", "n", "result"), ("factors", "n", "factor"),
    ("markets", "n", "market"), ("changes", "n", "change"), ("regulations", "n", "regulation"),
    ("rates", "n", "rate"), ("laws", "n", "law"), ("taxes", "n", "tax"), ("was", "v", "be"),
    ("were", "v", "be"), ("has", "v", "have"), ("had", "v", "have"), ("things", "n", "thing"),
    ("others", "n", "other"), ("ones", "n", "one"), ("lines", "n", "line"),
)


def stopwords_df(spark: SparkSession) -> DataFrame:
    return word_table(spark, [(w,) for w in C.STOPWORDS], ["word"])


def lemmas_df(spark: SparkSession) -> DataFrame:
    return word_table(spark, LEMMA_ROWS, ["word", "pos", "lemma"])


def word_table(spark: SparkSession, rows, names) -> DataFrame:
    """A short list as a table whose size Spark knows, so that it is broadcast. A table of Python objects has no known size:
    the tokens it is joined with would be shuffled and sorted."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def filings(t: Tables) -> DataFrame:
    """documents as filings: ``doc_id, symbol, filing_time ('yyyy-MM'), text``."""
    return as_filings(t.documents)


def as_filings(d: DataFrame) -> DataFrame:
    """Filing columns from any documents-shaped DataFrame (batch or micro-batch)."""
    year = (F.lit(FIRST_FILING_YEAR) + F.col("doc_id") % FILING_YEARS).cast("string")
    month = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    return d.select("doc_id", F.col("source").alias("symbol"),
                    F.concat(year, F.lit("-"), month).alias("filing_time"), "text")


def transcripts(t: Tables) -> DataFrame:
    """conversations as transcript components."""
    c = t.conversations
    return c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("component_order"),
                    F.col("role").alias("speaker_type"), "text")


def doc_labels(t: Tables) -> DataFrame:
    """labels as document-level action / noise flags."""
    return t.labels.select("doc_id", (F.col("quality") == 1).alias("is_action"),
                           (F.col("toxic") == 1).alias("is_noise"))


def filing_sentences(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    """Normalised filing sentences with voice and (left-joined) label flags, of all documents or those given.

    Columns: ``doc_id, sent_pos, symbol, filing_time, sentence, is_active, p_noise, is_action,
    is_noise``.
    Unlabelled documents keep their sentences with ``false`` flags.
    """
    f = TX.normalize(filings(t) if documents is None else as_filings(documents))
    s = TX.sentences(f, ["doc_id", "symbol", "filing_time"])
    s = TX.voice(s)
    lab = doc_labels(t)
    s = s.join(lab, "doc_id", "left")
    return s.select("doc_id", "sent_pos", "symbol", "filing_time", "sentence", "is_active",
                    F.round(stopword_share(F.col("sentence")), 6).alias("p_noise"),
                    F.coalesce("is_action", F.lit(False)).alias("is_action"),
                    F.coalesce("is_noise", F.lit(False)).alias("is_noise"))


def doc_tokens(t: Tables, spark: SparkSession, **more: Column) -> DataFrame:
    """Canonical tokens of normalised documents: ``doc_id, source, token`` (lemma, no stopwords), and ``more`` columns that
    are computed once per document."""
    d = TX.normalize(t.documents.select("doc_id", "source", "text", *[c.alias(n) for n, c in more.items()]))
    return TX.tokens(d, ["doc_id", "source", *more], stopwords=stopwords_df(spark), lemmas=lemmas_df(spark))


def topic_lexicon(t: Tables, spark: SparkSession, names=CLUSTERS) -> DataFrame:
    """Lexicon role: ``topic_num, keyword, drop, cosine_score, topic_name``.

    Top tokens per topic by count desc, token asc, over the documents of all sources. The window
    keeps ``row_number() <= k``, which Catalyst turns into a partial top-k before the shuffle.
    """
    return lexicon_of(topic_token_counts(t, spark, names), names)


def topic_token_counts(t: Tables, spark: SparkSession, names=CLUSTERS) -> DataFrame:
    """``topic_num, token, count`` over all documents: a source's topic is its hash modulo the topics."""
    topic = (md5_int(F.coalesce("source", F.lit(""))) % len(names)).cast("int")
    tok = doc_tokens(t, spark, topic_num=topic).where(F.length("token") >= LEXICON_MIN_LEN)
    return tok.groupBy("topic_num", "token").count()


def lexicon_counts(t: Tables, spark: SparkSession) -> DataFrame:
    """``source, token, count`` over all documents, staged: the lexicons of any topic names come from it, so that the
    documents' tokens are read once."""
    tok = doc_tokens(t, spark).where(F.length("token") >= LEXICON_MIN_LEN)
    return stage(spark, tok.groupBy("source", "token").count(), "lexicon_counts")


def lexicon_from_counts(counts: DataFrame, names=CLUSTERS) -> DataFrame:
    """``topic_lexicon`` from ``lexicon_counts``."""
    topic = (md5_int(F.coalesce("source", F.lit(""))) % len(names)).cast("int")
    return lexicon_of(counts.groupBy(topic.alias("topic_num"), "token").agg(F.sum("count").alias("count")), names)


def lexicon_of(counts: DataFrame, names=CLUSTERS) -> DataFrame:
    w = Window.partitionBy("topic_num").orderBy(F.desc("count"), F.asc("token"))
    top = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= LEXICON_TOP)
    # score: count relative to the topic's most frequent keyword (window over <= 20 rows per topic)
    score = F.round(F.col("count") / F.max("count").over(Window.partitionBy("topic_num")), 4)
    return top.select(
        "topic_num", F.col("token").alias("keyword"),
        F.when(F.length("token") % 5 == 0, F.lit(1)).cast("int").alias("drop"),
        score.alias("cosine_score"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("topic_num") + 1).alias("topic_name"))


def second_review(words: DataFrame) -> DataFrame:
    """Reviewer's role for an augmented word list: ``drop`` is 1 for words whose length is a multiple of SECOND_REVIEW."""
    return words.withColumn("drop", F.when(F.length("keyword") % SECOND_REVIEW == 0, F.lit(1)))


def word_vectors(tokens: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vector role: ``token, vector`` for the distinct tokens given."""
    distinct = tokens.select("token").distinct()
    keyed = distinct.withColumn("vec_id", md5_int(F.col("token")) % F.lit(max(1, embeddings.count())))
    return keyed.join(embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def keyed_vectors(embeddings: DataFrame) -> KeyedVectors:
    """Vector role: the same vectors as ``word_vectors``, by the key of a word."""
    n = max(1, embeddings.count())
    return KeyedVectors(lambda token: md5_int(token) % F.lit(n), embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")))


def bag_vectors(embeddings: DataFrame) -> DataFrame:
    """Topic-bag role: ``topic, vec_id, vector`` — per label, the BAG_SIZE vectors with the largest
    inner product with the label's mean vector (ties: the lowest ``vec_id``)."""
    x = embeddings.select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    mean = x.groupBy(F.col("label").alias("_l"), F.col("i").alias("_i")).agg(F.avg("x").alias("m"))
    near = x.join(mean, (F.col("label") == F.col("_l")) & (F.col("i") == F.col("_i"))).groupBy("label", "vec_id").agg(
        F.round(F.sum(F.col("x") * F.col("m")), 8).alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    top = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= BAG_SIZE)
    return top.join(embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select(
        F.col("label").alias("topic"), "vec_id", "vector")


# Raw-filing role of pages: filing dates, and the article between headings in one of these markups (by page number;
# two more numbers have no start, and no end, heading).
FIRST_FILED_YEAR, FILED_YEARS = 2002, 31
ARTICLE_RE = r"(?is)<article>(.*?)</article>"
HEADING_FORMS = (
    "<p>{0} {1}</p>", "<div><b>{0}</b> <b>{1}</b></div>", "<p>{0}<br>{1}</p>", "<div><p>{0}</p><p>{1}</p></div>",
    "<p><b>{0}&#xA0;&nbsp;{1}</b></p>", "<font size=2>{0} {1}</font>", "<table><tr><td>{0}</td><td> {1}:</td></tr></table>",
)
START_HEADING, END_HEADING = ("Item 1A.", "Risk Factors"), ("ITEM 1B.", "Unresolved Staff Comments")
CONTENTS = ("<table><tr><td>Item 1A.</td><td>Risk Factors</td><td>7</td></tr><tr><td>Item 1B. Unresolved Staff Comments</td></tr></table>"
            "<p>Item 1A. Risk Factors</p><div>Item 2. Properties</div><p>Business as in <b>Item 2</b> and elsewhere.</p>")


def filing_pages(t: Tables) -> DataFrame:
    """pages as filings: ``page_id, html``: contents, a heading, the page's article, the next heading. Pages without
    ``</html>`` stay without it."""
    p = t.pages.select("page_id", "html")
    n = len(HEADING_FORMS)
    form = F.col("page_id") % (n + 2)

    def heading(words):
        return F.element_at(F.array(*[F.lit(f.format(*words)) for f in HEADING_FORMS]), (form % n + 1).cast("int"))

    start = F.when(form == n, "<h1>Risks</h1>").otherwise(heading(START_HEADING))
    contents = F.when(form >= n, "<p>No contents.</p>").otherwise(F.lit(CONTENTS))
    end = F.when(form == n + 1, "<p>The end.</p>").otherwise(heading(END_HEADING))
    body = F.concat(F.lit("<html><body>"), contents, start, F.lit("\n"), F.regexp_extract("html", ARTICLE_RE, 1), end,
                    F.lit("<p>None.</p></body>"))
    return p.select("page_id", F.concat(body, F.when(F.col("html").rlike("(?i)</html>"), "</html>").otherwise("")).alias("html"))


def filed_pages(t: Tables) -> DataFrame:
    """pages as filings of a firm (the site) on a date: ``page_id, symbol, filed ('yyyyMMdd'), html``."""
    site = F.regexp_extract("url", r"([a-z0-9-]+)\.example\.", 1)
    filed = F.concat((F.lit(FIRST_FILED_YEAR) + F.col("page_id") % FILED_YEARS).cast("string"),
                     F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("15"))
    return t.pages.select("page_id", F.coalesce(F.when(site != "", site), F.lit("none")).alias("symbol"), filed.alias("filed"), "html")


def filings_with_header(t: Tables) -> DataFrame:
    """pages with a header block before them: ``page_id, raw``."""
    def line(name, value):
        return F.concat(F.lit(name + ":\t\t"), value, F.lit("\n"))

    return filed_pages(t).select("page_id", F.concat(
        F.lit("<SEC-HEADER>\n"), line("ACCESSION NUMBER", F.col("page_id").cast("string")), line("CONFORMED SUBMISSION TYPE", F.lit("10-K")),
        line("FILED AS OF DATE", F.col("filed")), line("  COMPANY CONFORMED NAME", F.col("symbol")), line("FILED AS OF DATE", F.lit("19000101")),
        F.lit("no field here\n</SEC-HEADER>\n"), F.coalesce("html", F.lit(""))).alias("raw"))
