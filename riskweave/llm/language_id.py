"""Language ID (operator 5): nearest of several centroids per language, by cosine.

A text becomes a vector of hashed character n-grams (orders 1 to 3, letters only, everything else a
space), weighted by TF-IDF and normalised. Each language's sample is clustered by spherical k-means; a
text gets the language of its nearest centroid. It is flagged as rejected where its similarity is below
what nearly all texts of that language in the sample have.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.chargrams import gram_ids, pieces
from riskweave.llm.common import crc_fold, small_batches, uniform_hash
from riskweave.plans.registry import register
from riskweave.sources.tables import read_table

ORDERS = (1, 2, 3)
BITS = 12
CENTROIDS = 4
# The fit's bounded sample: texts per language, of at most so many characters each.
SAMPLE_PER_LANG = 1000
SAMPLE_CHARS = 20_000
ROUNDS = 10
REJECT_QUANTILE = 0.005
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # float32, rows of length 1
    idf: np.ndarray
    floor: np.ndarray  # lowest usual similarity, per centroid


def counts(text: str) -> np.ndarray:
    """N-gram counts of the whole text."""
    out = np.zeros(1 << BITS, dtype=np.float32)
    for points in pieces(" " + _NOT_LETTERS.sub(" ", text.lower()) + " ", max(ORDERS) - 1):
        out += np.bincount(gram_ids(points, ORDERS, BITS), minlength=1 << BITS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(texts: list[str], langs: list[str], clusters: int = CENTROIDS) -> Model:
    """``clusters`` centroids per language (fewer where it has fewer texts); no texts: an empty model,
    with which every text is undetermined."""
    if not texts:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.ones(1 << BITS, np.float32), np.zeros(0))
    x = np.stack([counts(t) for t in texts])
    idf = (np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(x * idf)
    names, rows, floors = [], [], []
    lang = np.array(langs)
    for name in sorted(set(langs)):
        own = x[lang == name]
        rng = np.random.default_rng(7)
        centre = own[rng.permutation(len(own))[:clusters]]
        for _ in range(ROUNDS):
            near = np.argmax(own @ centre.T, axis=1)
            centre = np.stack([_unit(own[near == k].sum(axis=0)) if (near == k).any() else centre[k] for k in range(len(centre))])
        floor = float(np.quantile((own @ centre.T).max(axis=1), REJECT_QUANTILE))
        names += [name] * len(centre)
        rows.append(centre)
        floors += [floor] * len(centre)
    return Model(names, np.concatenate(rows).astype(np.float32), idf, np.array(floors))


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``SAMPLE_PER_LANG`` hash-chosen texts per language (texts over ``SAMPLE_CHARS``
    characters and those without a letter are no examples; null languages neither). Of the texts that one id has in a
    language, the smallest is taken, and null ids count as one id."""
    usable = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    # Rows per language over all rows (one row per language), so that the share to pick is known.
    sizes = usable.groupBy("_lang").agg(F.count("*").alias("_n"))
    rows = (usable.where(F.length("_text") <= SAMPLE_CHARS).join(F.broadcast(sizes), "_lang")
            .where(uniform_hash("_id", seed=5) * F.col("_n") < F.lit(float(SAMPLE_PER_LANG)))
            .groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).collect())
    rows = sorted((r for r in rows if _LETTER.search(r._text)), key=lambda r: (r._id is None, r._id or 0, r._text))
    return fit([r._text for r in rows], [r._lang for r in rows])


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, rejected``, one row per input row. ``lang_pred``: the nearest
    centroid's language (ties: the first in order of language); ``und`` with score 0 for a null text, one
    without a letter, or an empty model. ``rejected``: nearer to no centroid than texts of that
    language usually are. Only the text takes part."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tuple(model))  # a few centroids of fixed length per language
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_read_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, centroids, idf, floor = shared.value
        weighted = np.ascontiguousarray((centroids * idf).T)
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):  # 256 vectors at once
            texts = b.column(1).to_pylist()
            real = [i for i, t in enumerate(texts) if t and langs and _LETTER.search(t)]
            pred, score, out = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [True] * len(texts)
            if real:
                x = np.stack([counts(texts[i]) for i in real])
                sim = (x @ weighted) / np.maximum(np.linalg.norm(x * idf, axis=1), 1e-12)[:, None]
                for i, k, s in zip(real, sim.argmax(axis=1), sim.max(axis=1), strict=True):
                    pred[i], score[i], out[i] = langs[k], min(max(float(s), 0.0), 1.0), bool(s < floor[k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(out, pa.bool_())],
                                             names=[id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, f"`{id_col}` {dict(rows.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(crc_fold("doc_id", 5) != 0))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "rejected")
