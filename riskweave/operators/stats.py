"""Firm- and document-level statistics as single-pass conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def sentence_totals(df: DataFrame, keys: Sequence[str] = ("symbol", "filing_time")) -> DataFrame:
    """A1: sentences per (firm, time), plus active-only and action-only counts, in one pass."""
    return df.groupBy(*keys).agg(
        F.count("*").cast("long").alias("total_risk_sentence_count"),
        _count_if(F.col("is_active")).alias("total_active_sentence_count"),
        _count_if(F.col("is_action")).alias("total_action_sentence_count"))


def topic_pivot(tagged: DataFrame, topics: Sequence[int], keys: Sequence[str] = ("symbol", "filing_time"),
                prefix: str = "topic_reduced_") -> DataFrame:
    """A2: explode tags, count per (firm, time, topic), pivot on a fixed topic list, fill 0.

    The explicit value list means an absent topic still gets a 0 column (Q22) and Spark does
    not run an extra job to discover pivot values.
    """
    ex = tagged.select(*keys, F.explode("topic_ids").alias("topic"))
    pv = ex.groupBy(*keys).pivot("topic", list(topics)).count().na.fill(0)
    return pv.select(*keys, *[F.col(str(t)).cast("long").alias(f"{prefix}{t}") for t in topics])


def firm_year_topic_distribution(tagged: DataFrame, topics: Sequence[int],
                                 keys: Sequence[str] = ("symbol", "filing_time")) -> DataFrame:
    """J4 + A1 + A2: topic counts × {all, active, action} per firm-year in ONE aggregation.

    Equivalent to three pivots left-joined on (firm, time) with nulls → 0, without the joins.
    """
    has = {t: F.array_contains(F.col("topic_ids"), F.lit(t)) for t in topics}
    act, acn = F.col("is_active"), F.col("is_action")
    aggs = [F.count("*").cast("long").alias("total_risk_sentence_count")]
    aggs += [_count_if(has[t]).alias(f"topic_reduced_{t}") for t in topics]
    aggs += [_count_if(act).alias("total_active_sentence_count")]
    aggs += [_count_if(act & has[t]).alias(f"topic_reduced_active_{t}") for t in topics]
    aggs += [_count_if(acn).alias("total_action_sentence_count")]
    aggs += [_count_if(acn & has[t]).alias(f"topic_reduced_action_{t}") for t in topics]
    return tagged.groupBy(*keys).agg(*aggs)


def binary_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """tp/fp/fn/tn in ONE aggregate, then accuracy, precision, recall, F1."""
    t, p = F.col(truth), F.col(pred)
    c = df.agg(_count_if((p == 1) & (t == 1)).alias("tp"), _count_if((p == 1) & (t == 0)).alias("fp"),
               _count_if((p == 0) & (t == 1)).alias("fn"), _count_if((p == 0) & (t == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def ratio(num, den):
        return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), 6)

    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
