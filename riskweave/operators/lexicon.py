"""Topic lexicons: trimming, bags, keyword tagging, TF-IDF weights, similar-word expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.functions import text as FT
from riskweave.functions.misc import not_flagged
from riskweave.operators import text as TX


def trim(lexicon: DataFrame, flag_col: str = "drop") -> DataFrame:
    """Drop rows flagged 1; a blank (null) flag keeps the row, as ``flag != 1`` does in pandas."""
    return lexicon.where(not_flagged(F.col(flag_col)))


def bags(lexicon: DataFrame, topic_col: str = "topic_num", word_col: str = "keyword") -> DataFrame:
    """A3: one row per topic with its sorted, de-duplicated keyword list, ordered by topic."""
    return (lexicon.groupBy(topic_col)
            .agg(F.array_sort(F.collect_set(word_col)).alias("keywords")))


def retokenize(words: DataFrame, topic_col: str = "topic_num", word_col: str = "keyword", score_col: str = "cosine_score",
               stopwords: DataFrame | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """V6, second pass: keywords and phrases become the tokens they consist of, each once per topic with the best score
    it comes with (null only where all are). A phrase without a token leaves none."""
    toks = TX.tokens(words, [topic_col, score_col], text_col=word_col, stopwords=stopwords, lemmas=lemmas)
    return toks.groupBy(topic_col, F.col("token").alias(word_col)).agg(F.max(score_col).alias(score_col))


def one_topic_per_word(words: DataFrame, topic_col: str = "topic_num", word_col: str = "keyword",
                       score_col: str = "cosine_score") -> DataFrame:
    """A word that several topics hold stays in the one where it scores best (ties: the smallest topic; null is the lowest
    score); ``n_topics`` counts those that held it. Aggregated before the shuffle, so a word of any frequency is one row
    per task."""
    better = F.struct(F.coalesce(-F.col(score_col), F.lit(float("inf"))), F.col(topic_col))
    return words.groupBy(word_col).agg(
        F.min_by(F.struct(topic_col, score_col), better).alias("_b"), F.countDistinct(topic_col).alias("n_topics")).select(
        F.col(f"_b.{topic_col}").alias(topic_col), word_col, F.col(f"_b.{score_col}").alias(score_col), "n_topics")


def tag_by_keywords(sentences: DataFrame, keys: Sequence[str], lexicon: DataFrame,
                    stopwords: DataFrame | None = None, lemmas: DataFrame | None = None,
                    text_col: str = "sentence", carry: Sequence[str] = ()) -> DataFrame:
    """Tag each sentence with every topic whose bag shares a token with it.

    Returns ``keys + carry + topic_ids, n_tokens, n_hit_tokens`` (sorted ids, ``[-1]`` when
    nothing matches; content-token and keyword-hit counts). Tokens are
    exploded with only the small key/flag columns (never the text), the bounded lexicon is
    broadcast, and one aggregation by sentence key collapses the rows (partial aggregation
    map-side keeps the shuffle at about one row per sentence).
    """
    cols = list(keys) + [c for c in carry if c not in keys]
    x = sentences.select(*cols, F.explode_outer(FT.raw_tokens(F.col(text_col))).alias("token"))
    if lemmas is not None:
        x = TX.lemmatize(x, lemmas)
    if stopwords is not None:
        # mask (not drop) stopwords so a sentence made only of stopwords keeps its row
        sw = stopwords.select(F.col("word").alias("_sw"), F.lit(True).alias("_is_sw"))
        x = x.join(F.broadcast(sw), F.col("token") == F.col("_sw"), "left")
        x = x.withColumn("token", F.when(F.col("_is_sw"), F.lit(None)).otherwise(F.col("token"))).drop("_sw", "_is_sw")
    # one row per keyword with its topic list (bounded, broadcast): a token row never fans out
    lex = (lexicon.groupBy(F.col("keyword").alias("token"))
           .agg(F.collect_set(F.col("topic_num")).alias("_topics")))
    x = x.join(F.broadcast(lex), "token", "left")
    # group on the sentence key only; carried columns depend on it, so first() is exact
    extra = [F.first(c).alias(c) for c in cols if c not in keys]
    agg = x.groupBy(*keys).agg(
        *extra,
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_topics")))).alias("topic_ids"),
        F.count("token").cast("long").alias("n_tokens"),
        F.count("_topics").cast("long").alias("n_hit_tokens"))
    return agg.withColumn("topic_ids", F.when(F.size("topic_ids") > 0, F.col("topic_ids"))
                          .otherwise(F.array(F.lit(C.NULL_TOPIC))))


def tfidf_weights(lexicon: DataFrame, topic_col: str = "topic_num", word_col: str = "keyword",
                  n_docs: int | None = None) -> DataFrame:
    """TF-IDF of each bag treated as a document; smooth idf ``ln((1+n)/(1+df)) + 1``; L2 norm.

    Returns ``topic, term, weight``. The bag count ``n`` is one scalar aggregate.
    """
    tf = lexicon.groupBy(F.col(topic_col).alias("topic"), F.col(word_col).alias("term")).count()
    if n_docs is None:
        n_docs = tf.agg(F.countDistinct("topic")).first()[0]
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(df_, "term")
    raw = F.col("count") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)
    x = x.withColumn("raw", raw)
    w = Window.partitionBy("topic")
    return x.select("topic", "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w))).alias("weight"))
