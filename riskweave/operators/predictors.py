"""G1: predictor factories — build the topic side once, get back a DataFrame → DataFrame tagger.

Each factory takes the (bounded) topic description and returns ``tag(df, text_col=..., keys=...,
thresh=..., return_all_scores=False)``. With ``return_all_scores`` the long ``(keys, topic,
score)`` table is returned instead of tags (V7); otherwise ``keys + topic_ids`` with ``[-1]``
when no topic passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.operators import lexicon as LX
from riskweave.operators import tagging as TG
from riskweave.operators import text as TX

Tagger = Callable[..., DataFrame]


def _tokens(df, keys, text_col, stopwords, lemmas):
    return TX.tokens(df, keys, text_col=text_col, stopwords=stopwords, lemmas=lemmas)


def make_maxsim_tagger(bag_vectors: DataFrame, vectors_for: Callable[[DataFrame], DataFrame],
                       thresh_matching: float = C.MAXSIM_MATCH_DEFAULT, stopwords=None, lemmas=None) -> Tagger:
    """V1: ``bag_vectors(topic, vector)``; ``vectors_for(tokens) -> (token, vector)``."""
    bank = TG.bank_of(bag_vectors, "topic", "vector")

    def tag(df: DataFrame, keys: Sequence[str], text_col: str = "sentence",
            thresh: float = C.MAXSIM_TAG_DEFAULT, return_all_scores: bool = False) -> DataFrame:
        toks = _tokens(df, keys, text_col, stopwords, lemmas)
        tt = TG.maxsim_table(vectors_for(toks), bank, thresh_matching)
        scores = TG.maxsim_scores(toks, tt, keys)
        if return_all_scores:
            return scores
        return TG.tags_from_scores(df.select(*keys), scores, keys, thresh)

    return tag


def bag_words(bags: DataFrame, topic_col: str = "topic_num", word_col: str = "keyword", lemmas: DataFrame | None = None) -> DataFrame:
    """V1: the words of topic bags as ``topic, token``: bag entries (words or phrases) tokenised as texts are, each word
    once per topic."""
    words = TX.tokens(bags.select(F.col(topic_col).alias("topic"), F.col(word_col).alias("_phrase")), ["topic"], text_col="_phrase", lemmas=lemmas)
    return words.distinct()


def make_word_bag_tagger(bags: DataFrame, vectors_for: Callable[[DataFrame], DataFrame], thresh_matching: float = C.MAXSIM_MATCH_DEFAULT,
                         topic_col: str = "topic_num", word_col: str = "keyword", stopwords=None, lemmas=None) -> Tagger:
    """V1 from words: bag words are looked up in the word vectors like a text's own words; words without a vector take no
    part, and a bag of such words scores 0 everywhere. ``return_all_scores`` gives ``keys, scores``: one row per sentence,
    a score for every topic of ``bags`` in ascending order (0: no match)."""
    words = bag_words(bags, topic_col, word_col, lemmas)
    bank = TG.bank_of(words.join(vectors_for(words), "token").select("topic", "vector"), "topic", "vector")
    topics = sorted(r[0] for r in bags.select(topic_col).distinct().collect())  # the topics' names, as many as bags

    def tag(df: DataFrame, keys: Sequence[str], text_col: str = "sentence", thresh: float = C.MAXSIM_TAG_DEFAULT,
            return_all_scores: bool = False) -> DataFrame:
        toks = _tokens(df, keys, text_col, stopwords, lemmas)
        scores = TG.maxsim_scores(toks, TG.maxsim_table(vectors_for(toks), bank, thresh_matching), keys)
        if not return_all_scores:
            return TG.tags_from_scores(df.select(*keys), scores, keys, thresh)
        per = scores.groupBy(*keys).agg(*[F.sum(F.when(F.col("topic") == t, F.col("score"))).alias(f"_s{i}") for i, t in enumerate(topics)])
        out = df.select(*keys).join(per, list(keys), "left")
        return out.select(*keys, F.array(*[F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(len(topics))]).alias("scores"))

    return tag


def make_tfidf_tagger(lexicon: DataFrame, stopwords=None, lemmas=None, argmax_fallback: bool = False) -> Tagger:
    """TF-IDF cosine against bags; optional argmax fallback below the threshold."""
    weights = LX.tfidf_weights(lexicon)
    n = lexicon.select("topic_num").distinct().count()
    df_ = lexicon.select("topic_num", "keyword").distinct().groupBy(F.col("keyword").alias("term")).count()
    idf = df_.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("count"))) + 1).alias("idf"))
    default = C.TFIDF_ARGMAX_TAG_DEFAULT if argmax_fallback else C.TFIDF_TAG_DEFAULT

    def tag(df: DataFrame, keys: Sequence[str], text_col: str = "sentence", thresh: float = default,
            return_all_scores: bool = False) -> DataFrame:
        sims = TG.tfidf_sentence_cosine(_tokens(df, keys, text_col, stopwords, lemmas), weights, idf, keys)
        if return_all_scores:
            return sims
        out = TG.tags_from_scores(df.select(*keys), sims, keys, thresh, "sim")
        if not argmax_fallback:
            return out
        best = TG.argmax_topic(sims, keys).select(*keys, F.col("topic").alias("_best"))
        out = out.join(best, list(keys), "left")
        fb = F.array(F.coalesce(F.col("_best"), F.lit(0)))
        return out.withColumn("topic_ids", F.when(F.col("topic_ids")[0] == C.NULL_TOPIC, fb)
                              .otherwise(F.col("topic_ids"))).drop("_best")

    return tag


def make_dense_tagger(topic_vectors: DataFrame, vectors_for: Callable[[DataFrame], DataFrame],
                      top_k: int | None = None, stopwords=None, lemmas=None) -> Tagger:
    """V4 / V5: cosine of the sentence's mean token vector to each topic vector (optionally the
    ``top_k`` nearest only), tags ``> thresh``."""
    bank = TG.bank_of(topic_vectors, "topic", "vector")

    def tag(df: DataFrame, keys: Sequence[str], text_col: str = "sentence", thresh: float = C.DENSE_TAG_DEFAULT,
            return_all_scores: bool = False) -> DataFrame:
        toks = _tokens(df, keys, text_col, stopwords, lemmas)
        per = TG.mean_vectors(toks.join(vectors_for(toks), "token"), keys, "vector")
        sims = TG.cosine_to_bank(per, keys, "vector", bank)
        if top_k:
            sims = TG.top_k_topics(sims, keys, top_k, float("-inf"))
        if return_all_scores:
            return sims
        return TG.tags_from_scores(df.select(*keys), sims, keys, thresh, "sim")

    return tag


def make_keyword_tagger(lexicon: DataFrame, stopwords=None, lemmas=None) -> Tagger:
    """Exact keyword-match tagger (used by the firm-year distribution)."""

    def tag(df: DataFrame, keys: Sequence[str], text_col: str = "sentence", carry: Sequence[str] = ()) -> DataFrame:
        return LX.tag_by_keywords(df, keys, lexicon, stopwords, lemmas, text_col=text_col, carry=carry)

    return tag
