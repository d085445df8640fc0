"""Sentence attributes: one staged table that taggers and fitted models write into, and what is read from it.

The table has one row per sentence: its keys, its text, ``p_<name>`` for every scorer and ``topic_ids_<name>`` for every
tagger. Statistics and the sentence listing read the same rows, so that no attribute can shift against its sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import constants as C
from riskweave.operators import ml as ML
from riskweave.sources.files import scratch_path, stage

Scorer = Callable[[DataFrame], DataFrame]


def saved_model_scorer(spark: SparkSession, model: PipelineModel, out: str, text_col: str = "sentence") -> Scorer:
    """The fitted pipeline is saved under the shared folder and loaded again for scoring, so a job that scores needs
    no fit of its own. Adds the probability ``out``, narrow: each task scores the rows it reads."""
    path = scratch_path(spark, f"model_{out}")
    model.write().save(path)
    loaded = PipelineModel.load(path)

    def score(df: DataFrame) -> DataFrame:
        return ML.score(loaded, df.withColumn("text", F.col(text_col)), out).drop("text", f"{out}_label")

    return score


def sentence_attributes(spark: SparkSession, sentences: DataFrame, keys: Sequence[str], taggers: Mapping[str, Callable],
                        scorers: Mapping[str, Callable], text_col: str = "sentence") -> DataFrame:
    """The staged attribute table of ``sentences`` (``keys`` are unique). ``scorers``: name → function that adds ``p_name``
    to the rows; ``taggers``: name → ``tag(df, keys=..., text_col=...)`` that gives keys and ``topic_ids`` (``[-1]``: none).
    A sentence no tagger returns has ``[-1]``."""
    x = sentences
    for score in scorers.values():
        x = score(x)
    base = stage(spark, x, "sentence_scores")
    out = base
    for name, tag in taggers.items():
        tags = tag(base.select(*keys, text_col), keys=list(keys), text_col=text_col).select(*keys, F.col("topic_ids").alias(f"topic_ids_{name}"))
        out = out.join(tags, list(keys), "left").withColumn(
            f"topic_ids_{name}", F.coalesce(f"topic_ids_{name}", F.array(F.lit(C.NULL_TOPIC))))
    return stage(spark, out, "sentence_attributes")


def topic_statistics(attributes: DataFrame, keys: Sequence[str], topics: Mapping[str, Sequence[str]], every: DataFrame,
                     action: Column, noise: Column | None = None) -> DataFrame:
    """A8 + A9 + PL6: per ``keys``, sentences and actions in all, and per topic of every kind (``topics``: kind → names; id i
    has the i-th name), with totals per kind, in one aggregation. Noise sentences count nowhere; ``every`` (with the keys, and
    columns to keep) has a row for each result, also without sentences."""
    kept = attributes if noise is None else attributes.where(~F.coalesce(noise, F.lit(False)))
    act = F.coalesce(action, F.lit(False))
    aggs = [F.count("*").cast("long").alias("n_sentences"), F.count_if(act).cast("long").alias("n_actions")]
    for kind, names in topics.items():
        for i, name in enumerate(names):
            has = F.array_contains(f"topic_ids_{kind}", F.lit(i))
            aggs += [F.count_if(has).cast("long").alias(f"n_sentences_topic_{kind}_{name}"),
                     F.count_if(act & has).cast("long").alias(f"n_actions_topic_{kind}_{name}")]
    counts = kept.groupBy(*keys).agg(*aggs)
    out = every.join(counts, list(keys), "left").fillna(0, [c for c in counts.columns if c.startswith("n_")])
    for kind, names in topics.items():
        for what in ("sentences", "actions"):
            total = sum((F.col(f"n_{what}_topic_{kind}_{n}") for n in names), F.lit(0))
            out = out.withColumn(f"n_{what}_topic_{kind}_total", total.cast("long"))
    return out


def topic_names(ids: Column, names: Sequence[str], none: str = "null") -> Column:
    """Comma-joined names of topic ids, ``none`` for the id of no topic."""
    known = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(ids, lambda i: F.when(i >= 0, F.try_element_at(known, (i + 1).cast("int"))).otherwise(F.lit(none))), ", ")


def sentence_listing(attributes: DataFrame, keep: Sequence[str], topics: Mapping[str, Sequence[str]], noise: Column,
                     text_col: str = "sentence") -> DataFrame:
    """PL6: one row per sentence that is no noise: ``keep``, the sentence, topic names of every kind, probabilities."""
    kept = attributes.where(~F.coalesce(noise, F.lit(False)))
    probabilities = [c for c in attributes.columns if c.startswith("p_")]
    return kept.select(*keep, text_col, *[topic_names(F.col(f"topic_ids_{k}"), n).alias(f"topic_names_{k}") for k, n in topics.items()],
                       *probabilities)
