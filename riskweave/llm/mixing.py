"""Mixing sources to target weights (operator 1).

Every document gets a hash-random key. Within its source, documents are in key order, cut into ranges of the key's
leading digits; a range's running sum of sizes plus the sums of the ranges before it is the document's prefix sum.
A source is repeated for each whole time its size fits in its target; of the last, partial epoch it gives the
documents in key order up to exactly its budget, the last of them in part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import ASCII_SPACE, small_batches
from riskweave.operators.prefix import ordered_prefix
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

MAX_EPOCHS = 3
RANGE_DIGITS = 3  # hex digits of the key: 4096 ranges per source

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(ASCII_SPACE)] = True


def count_words(texts: pa.Array) -> pa.Array:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: 0), counted on the column's bytes."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data and len(texts) else np.zeros(0, np.uint8)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = (at - at[0])[:-1]
    begin = begin[begin < len(raw)]
    first[begin] = word[begin]  # a word never goes on into the next text
    upto = np.concatenate([[0], np.cumsum(first)])
    return pa.array(np.diff(upto[at - at[0]]), pa.int64())


def word_count(text: Column) -> Column:
    return F.arrow_udf(count_words, "long")(text)


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "source_size",
                   max_epochs: int = MAX_EPOCHS, cycle: int = 3) -> DataFrame:
    """Adds ``target`` to one row per source. Sources in code-point order, null last, weigh 1, 2, ... ``cycle`` and
    again; they share the sum of all sizes by weight, a target stops at ``max_epochs`` times its source's size and
    the excess goes to the others by weight. That is target = min(weight * level, cap) for one level, found in order
    of cap / weight. All sources of size 0 get 0."""
    ordered = ordered_prefix(sizes.withColumn("_one", F.lit(1)), [F.col(source_col).asc_nulls_last()], {"_i": "_one"})
    capped = ordered.select(source_col, size_col, (F.col("_i") % cycle + 1).alias("_w"),
                            (F.col(size_col) * max_epochs).alias("_cap"))
    total = capped.agg(F.sum(size_col).alias("b"), F.sum("_w").alias("w")).first()
    if not total.b:
        return sizes.withColumn("target", F.lit(0.0))
    filled = ordered_prefix(capped, [F.col("_cap") / F.col("_w"), F.col(source_col).asc_nulls_last()],
                            {"_caps": "_cap", "_ws": "_w"})
    level = (F.lit(total.b) - F.col("_caps")) / (F.lit(total.w) - F.col("_ws"))
    # The level of the first source, in order of cap / weight, that stays below its cap.
    at = filled.where(F.col("_cap") / F.col("_w") >= level).agg(F.min_by(level, F.struct(F.col("_cap") / F.col("_w"), "_ws")))
    found = at.first()[0]
    target = F.col("_cap").cast("double") if found is None else F.least(F.col("_w") * F.lit(found), F.col("_cap").cast("double"))
    return filled.select(source_col, size_col, target.alias("target"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 0, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, source_col, ``size`` (words; null text 0), ``source_size``, ``target`` (its
    source's), ``taken`` (words of it in the mix, repeats counted; at most ``max_epochs`` times its size) and the
    ``keep`` columns. The words taken of a source sum to its target, rounded. Null is a source of its own; a document
    without words is never taken. Rows with equal ids are ordered by size. Keys depend on ``seed`` and the id alone,
    so reruns agree under any partitioning."""
    small_batches(documents.sparkSession)
    # Work columns are numbered, so that kept columns of any name do not clash with them.
    rows = documents.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)],
                            word_count(F.col(text_col).cast("string")).alias("_size"),
                            F.md5(F.concat_ws("#", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary")).alias("_key"))
    rows = rows.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = stage(documents.sparkSession, rows.groupBy("_src", "_range").agg(F.sum("_size").alias("_n")), "mix_ranges")
    sources = ranges.groupBy("_src").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sources, "_src", max_epochs=max_epochs)
    # At most 4096 rows per source here, whatever its number of documents.
    w = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("_src").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    t = targets.select(F.col("_src").alias("_ts"), "source_size", "target")
    offsets = offsets.join(t, F.col("_s").eqNullSafe(F.col("_ts"))).drop("_ts")
    rows = rows.join(offsets, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    local = Window.partitionBy("_src", "_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - F.col("_whole") * F.col("source_size") - F.col("_off") - F.col("_before")
    return (rows.withColumn("_before", F.coalesce(F.sum("_size").over(local), F.lit(0))).withColumn("_whole", whole)
            .select(F.col("_id").alias(id_col), F.col("_src").alias(source_col), F.col("_size").alias("size"), "source_size", "target",
                    (F.col("_whole") * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest))).cast("long").alias("taken"),
                    *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]))


_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '#0')) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, (source_size * 3) / w AS r FROM s),
p AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level,
             row_number() OVER o AS i
      FROM c WINDOW o AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT min_by(level, i) AS level FROM p WHERE r >= level),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(w * f.level, cap)::DOUBLE AS target FROM c, f),
b AS (SELECT doc_id, d.source, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM b
"""


@register("op1_mixing", _SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
