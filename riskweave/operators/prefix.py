"""Distributed running sums over a total order: no task ever holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.files import stage


def ordered_prefix(df: DataFrame, order_by: Sequence[Column | str], sums: dict[str, str],
                   partition_by: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Add ``out = sum(value)`` over all rows strictly before a row, for each ``{out: value}``.

    Rows are range-partitioned by ``partition_by + order_by`` and staged once, so the bucket of a
    row (its range partition) is fixed however often the table is read. Each bucket computes a
    local running sum; the per-bucket totals (one row per bucket and group, at most
    ``num_partitions`` per group) give the offsets. Rows equal in ``order_by`` get their sums in
    an unspecified order among themselves; make the order total where that matters.
    The staged table also keeps ``_pid``, the bucket.
    """
    spark = df.sparkSession
    part = list(partition_by)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = stage(spark, df.repartitionByRange(n, *part, *order_by)
                   .withColumn("_pid", F.spark_partition_id()), "ordered_prefix")
    before = (Window.unboundedPreceding, -1)
    local = Window.partitionBy("_pid", *part).orderBy(*order_by).rowsBetween(*before)
    rows = staged.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_l_{o}") for o, v in sums.items()])
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(part)]
    totals = staged.groupBy(F.col("_pid").alias("_kp"), *keys).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    across = Window.partitionBy(*[f"_k{i}" for i in range(len(part))]).orderBy("_kp").rowsBetween(*before)
    offsets = totals.select("_kp", *[f"_k{i}" for i in range(len(part))],
                            *[F.coalesce(F.sum(f"_t_{o}").over(across), F.lit(0)).alias(f"_o_{o}") for o in sums])
    same = F.col("_pid") == F.col("_kp")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(offsets, same).select(
        *df.columns, "_pid", *[(F.col(f"_l_{o}") + F.col(f"_o_{o}")).cast("long").alias(o) for o in sums])
