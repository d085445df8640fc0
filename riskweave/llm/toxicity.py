"""Toxicity (operator 10): linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased whole text. Feature f has the value
r[f] = log(share of label-1 texts that hold f / share of label-0 texts that do). The features whose ratio, of either sign,
is clearly not 0 (by ``MIN_STRENGTH`` standard errors, so a text's many ordinary n-grams do not drown what marks it) enter
a logistic regression on these values. The weights are a vector of fixed size (``2**BITS``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.chargrams import gram_ids, pieces
from riskweave.llm.common import crc_fold, small_batches
from riskweave.plans.registry import register
from riskweave.sources.tables import read_table

ORDERS = (4, 5)
BITS = 20
MIN_TEXTS = 3
MIN_STRENGTH = 4.0  # standard errors that a feature's log ratio must be away from 0
# The fit's bounded sample of labelled rows: this many per class, of at most so many characters each.
SAMPLE_PER_CLASS = 2000
SAMPLE_CHARS = 20_000
STEPS = 120
THRESHOLD = 0.3


class Model(NamedTuple):
    weights: np.ndarray  # float32, 2**BITS
    intercept: float


def features(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct n-gram buckets of the whole text, optionally only the ``wanted`` ones."""
    found = []
    for points in pieces((text or "").lower(), max(ORDERS) - 1):
        ids = gram_ids(points, ORDERS, BITS)
        found.append(np.unique(ids if wanted is None else ids[wanted[ids]]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def fit(texts: list[str], labels: list[int], positive_rate: float) -> Model:
    """``positive_rate``: the share of label 1 among all labelled rows; the sample is balanced by
    weights and the intercept is then moved back to that share. Without examples of one class the
    model gives 0 (no label 1) or 1 (no label 0) for every text."""
    y = np.asarray(labels, dtype=np.float64)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not len(y) or y.max() < 1:
        return Model(weights, -30.0)
    if y.min() > 0:
        return Model(weights, 30.0)
    sets = [features(t) for t in texts]
    ids = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ones = np.bincount(ids, weights=y[row], minlength=1 << BITS)
    total = np.bincount(ids, minlength=1 << BITS)
    p, q = ones + 1, total - ones + 1
    ratio = np.log(p / (y.sum() + 2)) - np.log(q / ((1 - y).sum() + 2))
    strength = np.abs(ratio) / np.sqrt(1 / p + 1 / q)  # in standard errors of the log ratio
    keep = (total >= MIN_TEXTS) & (strength >= MIN_STRENGTH)
    at = np.cumsum(keep) - 1
    used = keep[ids]
    col, row, size = at[ids[used]], row[used], int(keep.sum())
    scale = ratio[keep]
    value = scale[col]
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, weights=w[col] * value, minlength=len(y)) + w[-1]
        slope = (_sigmoid(margin) - y) * cost
        grad = np.append(np.bincount(col, weights=slope[row] * value, minlength=size) + 1e-3 * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights[keep] = w[:-1] * scale
    prior = min(max(positive_rate, 1e-6), 1 - 1e-6)
    return Model(weights, float(w[-1] + np.log(prior / (1 - prior))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Fit on a bounded sample: per class the ``SAMPLE_PER_CLASS`` labelled ids of smallest hash whose
    texts have at most ``SAMPLE_CHARS`` characters. Null ids, labels and texts are left out; an id with
    several labels counts as the largest, of an id with several texts the smallest is taken."""
    lab = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y")))
    share = lab.agg(F.avg("_y")).first()[0] or 0.0
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    # The id list has at most 2 * SAMPLE_PER_CLASS rows: a bounded broadcast.
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(
        F.col("_text").isNotNull() & (F.length("_text") <= SAMPLE_CHARS))
    # One text per id, however many rows have it, so at most 2 * SAMPLE_PER_CLASS texts reach the driver.
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: r._id)
    return fit([r._text for r in rows], [r._y for r in rows], share)


def score_texts(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's rows and columns with ``score_col`` (0 to 1) added (in place of a column of that name). A null or
    empty text has no n-grams and gets the intercept's score. Texts of any length are scored whole."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tuple(model))  # 4 bytes * 2**BITS, whatever the corpus

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, intercept = shared.value
        wanted = weights != 0
        margins = [float(weights[features(t, wanted)].sum(dtype=np.float64)) + intercept for t in texts.to_pylist()]
        return pa.array(_sigmoid(np.array(margins, dtype=np.float64)), pa.float64())

    return documents.withColumn(score_col, score(F.col(text_col).cast("string")))


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2)
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
