"""Topic taggers: MaxSim keyword matching, TF-IDF cosine, dense cosine, top-k, argmax.

The large side (sentences, tokens) always stays distributed. A topic bank (topics × words per bag) of
checked size is shipped to tasks inside an Arrow ``mapInPandas`` step, where numpy does the small matrix
products; a larger one stays a table and meets the large side block by block, with the same result.
Every per-sentence score is then a plain Spark join + aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import constants as C
from riskweave.sources.files import stage

# A bank of at most this many vectors is shipped to tasks; a larger one is joined in blocks of this size.
MAX_BANK_ROWS = 100_000
# Rows of the large side that meet one block of a large bank in one task, about.
BLOCK_ROWS = 100_000
# Words of the rows that meet their vectors in one task, about, and vectors summed at a time there (those of one row at least).
GROUP_WORDS, SUM_ROWS = 4_000_000, 1 << 16
# Similarities are rounded to this many decimals so that ties and thresholds do not depend on
# BLAS summation order (which varies with batch shape).
SIM_DECIMALS = 10


# Between the words of a bag, which are one string: an array takes twice the room where it is shuffled. No word holds it.
WORD_GAP = "\x1f"


class KeyedVectors(NamedTuple):
    """Vectors of words: a word's key, null without one, and a table of ``key, vector`` whose rows many words may share."""

    key: Callable[[Column], Column]
    table: DataFrame


class Bank(NamedTuple):
    """Topic vectors: a table of (topic, vector), and arrays of the same where it is small."""

    frame: DataFrame
    rows: int
    topics: np.ndarray | None
    unit: np.ndarray | None


def bank_of(bank: DataFrame, topic_col: str, vec_col: str) -> Bank:
    spark = bank.sparkSession
    frame = stage(spark, bank.select(F.col(topic_col).cast("int").alias("topic"), F.col(vec_col).cast("array<double>").alias("vector")), "bank")
    n = frame.count()
    if n > MAX_BANK_ROWS:
        return Bank(frame, n, None, None)
    return Bank(frame, n, *_arrays(frame.toPandas()))


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("topic", kind="stable")
    return pdf.topic.to_numpy(), _unit_rows(pdf.vector) if len(pdf) else np.zeros((0, 0))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _with_bank(df: DataFrame, bank: Bank, run, schema: T.StructType) -> DataFrame:
    """``run(rows, topics, unit vectors)`` on batches of ``df`` and the whole bank, or each of its blocks."""
    if bank.unit is not None:
        topics, unit = bank.topics, bank.unit

        def each(batches):
            for pdf in batches:
                if len(pdf) and len(topics):
                    yield run(pdf, topics, unit)

        return df.mapInPandas(each, schema)
    spark = df.sparkSession
    df = stage(spark, df, "bank_side")
    blocks = -(-bank.rows // MAX_BANK_ROWS)
    groups = max(1, -(-df.count() // BLOCK_ROWS))
    key = F.xxhash64(*df.columns)
    left = df.select("*", F.pmod(key, F.lit(groups)).alias("_g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_b"))
    right = bank.frame.select("topic", "vector", F.pmod(F.xxhash64("topic", "vector"), F.lit(blocks)).alias("_b"),
                              F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_g"))

    def meet(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(block):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return run(rows, *_arrays(block))

    return left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInPandas(meet, schema)


def maxsim_table(word_vectors: DataFrame, bank: Bank, thresh_matching: float, key: str = "token",
                 vec_col: str = "vector") -> DataFrame:
    """Step 1 of MaxSim: per distinct word, the best cosine to each topic's words, kept only if
    ``> thresh_matching`` (pruning before the join removes common off-topic tokens)."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("topic", T.IntegerType()),
                           T.StructField("maxsim", T.DoubleType())])

    def run(pdf, topics, unit):
        sims = np.round(_unit_rows(pdf[vec_col]) @ unit.T, SIM_DECIMALS)
        outs = []
        for t in np.unique(topics):
            best = sims[:, topics == t].max(axis=1)
            keep = best > thresh_matching
            outs.append(pd.DataFrame({key: pdf[key].values[keep], "topic": np.full(int(keep.sum()), t, np.int32), "maxsim": best[keep]}))
        return pd.concat(outs, ignore_index=True)

    out = _with_bank(word_vectors.select(key, vec_col), bank, run, schema)
    return out if bank.unit is not None else out.groupBy(key, "topic").agg(F.max("maxsim").alias("maxsim"))


def cosine_to_bank(df: DataFrame, keys: Sequence[str], vec_col: str, bank: Bank, above: float | None = None,
                   least: float | None = None) -> DataFrame:
    """Cosine of each row's vector to every bank vector: ``keys + topic, sim``, one row per bank row, or
    only those with ``sim > above`` and ``sim >= least`` (dropped in the task that computes them)."""
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("topic", T.IntegerType()), T.StructField("sim", T.DoubleType())])

    def run(pdf, topics, unit):
        sims = np.round(_unit_rows(pdf[vec_col]) @ unit.T, SIM_DECIMALS)
        keep = np.ones(sims.shape, dtype=bool)
        if above is not None:
            keep &= sims > above
        if least is not None:
            keep &= sims >= least
        row, col = np.nonzero(keep)
        return pd.DataFrame({**{k: pdf[k].values[row] for k in keys}, "topic": topics[col], "sim": sims[row, col]})

    return _with_bank(df.select(*keys, vec_col), bank, run, schema)


def mean_vectors(rows: DataFrame, keys: Sequence[str], vec_col: str) -> DataFrame:
    """Mean vector per key, summed on the map side (no list of vectors is ever shuffled)."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col)))
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias(vec_col))


def weighted_mean_vectors(rows: DataFrame, keys: Sequence[str], vec_col: str, weight_col: str) -> DataFrame:
    """Mean vector per key, each row with its weight (a token's vector is joined once per key, not per occurrence)."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col)), F.col(weight_col).cast("double"))
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias(vec_col))


def word_bags(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``token`` rows of a key as one string, staged: ``keys + _words`` (the words in between ``WORD_GAP``)."""
    words = F.array_join(F.collect_list("token"), WORD_GAP)
    return stage(rows.sparkSession, rows.groupBy(*keys).agg(words.alias("_words")), "word_bags")


def bag_words(bag: Column | str = "_words") -> Column:
    """A bag's words as an array."""
    return F.split(bag, WORD_GAP)


def words_by_group(bags: DataFrame, keys: Sequence[str], vectors_of: KeyedVectors | Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``word_bags`` dealt into groups of keys, ``keys + _words, _g``, and the vectors of a group's words, ``_g, tokens, vector``
    (all words of the group that share a row of the vectors). ``vectors_of`` gives ``token, vector`` for a table of tokens, or
    tells the words' keys.

    Words are shuffled as one string per key, and a vector once per group of keys that holds its word, never per occurrence or
    key: the groups have about ``GROUP_WORDS`` words. With keys, words that share a vector have it once per group."""
    groups = max(1, -(-(bags.agg(F.sum(F.size(bag_words()))).first()[0] or 0) // GROUP_WORDS))
    bags = bags.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    words = bags.select(F.col("_g").alias("_g"), F.explode(bag_words()).alias("token"))
    if isinstance(vectors_of, KeyedVectors):
        shared = words.distinct().groupBy("_g", vectors_of.key(F.col("token")).alias("key")).agg(F.collect_list("token").alias("tokens"))
        return bags, shared.join(vectors_of.table.where(F.col("vector").isNotNull()), "key").select("_g", "tokens", "vector")
    held = stage(bags.sparkSession, words.distinct(), "group_words")
    return bags, held.join(vectors_of(held.select("token")).where(F.col("vector").isNotNull()), "token").select(
        "_g", F.array("token").alias("tokens"), "vector")


def group_vectors(right: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a group's vectors: tokens in order, the row of the vector of each (a token may come with several), and the vectors."""
    tokens, flat = right["tokens"].combine_chunks(), right["vector"].combine_chunks()
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())
    order = pc.sort_indices(tokens.flatten())
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    return tokens.flatten().take(order), row[order.to_numpy()], x


def word_codes(bags: pa.ChunkedArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` (distinct words) of the words of all bags, -1 for others, and the number of words of each bag."""
    words = pc.split_pattern(bags.combine_chunks(), WORD_GAP)
    return pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(), pc.list_value_length(words).to_numpy()


def mean_word_vectors(rows: DataFrame, keys: Sequence[str], vectors_of: KeyedVectors | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean vector per key of its ``token`` rows, each occurrence counted: ``keys + vector``; tokens without a vector take no
    part, and keys without any such token have no row. A task adds up the vectors of one group of keys (``words_by_group``)."""
    return mean_bag_vectors(word_bags(rows, keys), keys, vectors_of)


def mean_bag_vectors(bags: DataFrame, keys: Sequence[str], vectors_of: KeyedVectors | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``mean_word_vectors`` of ``word_bags``."""
    keys = list(keys)
    bags, vectors = words_by_group(bags, keys, vectors_of)
    schema = T.StructType([f for f in bags.schema.fields if f.name in keys] + [T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def means(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [left[k].combine_chunks() for k in keys]
        if not len(left) or not len(right):
            return pa.table([c.slice(0, 0) for c in cols] + [pa.array([], pa.list_(pa.float64()))], names=[*keys, "vector"])
        token, at, x = group_vectors(right)
        known = token.dictionary_encode()
        times = np.bincount(known.indices, minlength=len(known.dictionary)).astype(np.float64)
        if len(known.dictionary) < len(token):  # a word with several vectors counts each
            total = np.zeros((len(known.dictionary), x.shape[1]))
            np.add.at(total, known.indices.to_numpy(), x[at])
            at, x = np.arange(len(total)), total
        code, sizes = word_codes(left["_words"], known.dictionary)
        row = np.repeat(np.arange(len(left)), sizes)
        code, row = code[code >= 0], row[code >= 0]
        n = np.bincount(row, weights=times[code], minlength=len(left))
        at = at[code]
        kept = np.flatnonzero(n)
        out = np.empty((len(kept), x.shape[1]))
        first = np.searchsorted(row, kept)
        behind = np.append(first[1:], len(row))
        i = 0
        while i < len(kept):
            j = max(i + 1, int(np.searchsorted(behind, first[i] + SUM_ROWS, side="right")))
            out[i:j] = np.add.reduceat(x[at[first[i]:behind[j - 1]]].astype(np.float64), first[i:j] - first[i], axis=0)
            i = j
        out /= n[kept, None]
        vector = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * x.shape[1]), pa.array(out.ravel()))
        return pa.table([c.take(pa.array(kept)) for c in cols] + [vector], names=[*keys, "vector"])

    return bags.groupBy("_g").cogroup(vectors.groupBy("_g")).applyInArrow(means, schema)


def maxsim_scores(sent_tokens: DataFrame, token_topic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps 2-3 of MaxSim: every token occurrence adds its word's maxsim to the topic score.

    ``token_topic`` is pruned and at most (distinct words × topics) rows; AQE broadcasts it when
    small, otherwise a sort-merge join with skew splitting handles frequent tokens.
    """
    j = sent_tokens.select(*keys, "token").join(token_topic, "token")
    return j.groupBy(*keys, "topic").agg(F.sum("maxsim").alias("score"))


def tags_from_scores(sentences: DataFrame, scores: DataFrame, keys: Sequence[str], thresh: float,
                     score_col: str = "score", strict: bool = True) -> DataFrame:
    """Topics whose score passes ``thresh`` (sorted ids), ``[-1]`` when none; every sentence kept."""
    cond = F.col(score_col) > thresh if strict else F.col(score_col) >= thresh
    hit = scores.where(cond).groupBy(*keys).agg(F.array_sort(F.collect_list("topic")).alias("topic_ids"))
    out = sentences.join(hit, list(keys), "left")
    return out.withColumn("topic_ids", F.coalesce(F.col("topic_ids"), F.array(F.lit(C.NULL_TOPIC))))


def tfidf_sentence_cosine(sent_tokens: DataFrame, weights: DataFrame, idf: DataFrame,
                          keys: Sequence[str]) -> DataFrame:
    """V2: cosine between each sentence's TF-IDF vector (bag vocabulary, same idf) and each bag.

    ``weights(topic, term, weight)`` are L2-normalised bag vectors; ``idf(term, idf)`` is bounded
    by the vocabulary; Spark broadcasts them where they are small. Output ``keys + topic, sim`` for sim > 0.
    """
    tf = (sent_tokens.select(*keys, F.col("token").alias("term"))
          .join(idf, "term")
          .groupBy(*keys, "term", "idf").agg(F.count("*").alias("tf")))
    tf = tf.withColumn("w", F.col("tf") * F.col("idf"))
    norm = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (tf.join(weights, "term")
            .groupBy(*keys, "topic").agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    sim = F.round(F.col("dot") / F.col("norm"), SIM_DECIMALS)
    return dots.join(norm, list(keys)).select(*keys, "topic", sim.alias("sim"))


def argmax_topic(scores: DataFrame, keys: Sequence[str], score_col: str = "sim") -> DataFrame:
    """Best topic per sentence, lowest id on ties (``max_by`` over (score, -topic))."""
    best = F.max(F.struct(F.col(score_col), (-F.col("topic")).alias("neg")))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.neg")).alias("topic"),
                                                               F.col(f"_b.{score_col}").alias(score_col))


def top_k_topics(scores: DataFrame, keys: Sequence[str], k: int, thresh: float,
                 score_col: str = "sim") -> DataFrame:
    """The k best topics per row (score desc, topic asc), then keep those ``> thresh``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score_col), F.asc("topic"))
    return (scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .where(F.col(score_col) > thresh).drop("_rn"))


def centroids(vectors: DataFrame, group: str, vec_col: str) -> DataFrame:
    """Per group, the mean of the unit vectors (dimension-wise ``avg`` after ``posexplode``)."""
    from riskweave.functions.vectors import unit
    ex = vectors.select(group, F.posexplode(unit(F.col(vec_col))).alias("d", "x"))
    per = ex.groupBy(group, "d").agg(F.avg("x").alias("x"))
    return per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))),
                                              lambda s: s["x"]).alias("centroid"))


def argmax_tags(sentences: DataFrame, sims: DataFrame, keys: Sequence[str], thresh: float, first_topic: int = 0) -> DataFrame:
    """The sentences with ``topic_ids``: sorted topics above ``thresh``, else the best topic (ties: the smallest),
    else, where no topic scores, ``first_topic``. One aggregate of the scores and one join, whatever the sentences carry.
    A null score counts as none."""
    best = sims.where(F.col("sim").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("sim") > thresh, F.col("topic")))).alias("_above"),
        F.min_by("topic", F.struct(-F.col("sim"), F.col("topic"))).alias("_best"))
    out = sentences.join(best, list(keys), "left")
    tags = F.when(F.size("_above") > 0, F.col("_above")).otherwise(F.array(F.coalesce("_best", F.lit(first_topic))))
    return out.withColumn("topic_ids", tags).drop("_above", "_best")
