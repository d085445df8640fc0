"""Relational operators: latest version, prefix entity resolution, lookups, flags, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``RANK() OVER (PARTITION BY key ORDER BY order...) = 1`` — ties are kept (Q13).

    Catalyst plans a ``WindowGroupLimit`` for this filter, so each map task keeps only its local
    rank-1 rows before the shuffle; a hot key costs one small partial group per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") == 1).drop("_rk")


def resolve_by_prefix(queries: DataFrame, entities: DataFrame, *, q_name: str = "name",
                      q_country: str = "country_id", e_id: str = "entity_id", e_name: str = "entity_name",
                      e_country: str = "country_id") -> DataFrame:
    """Match each query to an entity whose lower-cased name starts with the query name.

    Preference: an entity in the query's country (smallest id), else the entity with the highest
    country id (then smallest id), else not found. The theta join becomes two equi joins: every
    entity emits its name prefixes of exactly the lengths that occur among the query names (a
    join on the length; exact, no cap) and is pre-aggregated to ONE best candidate per (prefix,
    country) and, from those, per prefix, so a popular prefix never fans out and every query joins
    against unique keys. Adds ``resolved_id`` and ``match_type``.
    """
    qk = F.lower(F.col(q_name))
    lengths = queries.select(F.length(qk).alias("_n")).where("_n IS NOT NULL").distinct()
    name = F.lower(F.col(e_name))
    e = entities.select(F.col(e_id).alias("_id"), F.col(e_country).alias("_cty"), name.alias("_name"),
                        F.explode(F.sequence(F.lit(0), F.length(name))).alias("_n"))
    # A plan's size estimate knows nothing of this explode: without hints the prefixes, many times the entities, are sent to
    # the driver and broadcast, here and in the joins below. The lengths are at most as many as a name's characters.
    e = e.join(F.broadcast(lengths), "_n").select("_id", "_cty", F.expr("substring(_name, 1, _n)").alias("_prefix"))
    in_country = e.groupBy("_prefix", "_cty").agg(F.min("_id").alias("_id_in"))
    # highest country id, then smallest entity id: max of (country, -id)
    best = in_country.groupBy("_prefix").agg(F.max(F.struct(F.col("_cty"), (-F.col("_id_in")).alias("neg"))).alias("_b"))
    best = best.select(F.col("_prefix").alias("_prefix2"), (-F.col("_b.neg")).alias("_id_any"))
    in_country, best = in_country.hint("merge"), best.hint("merge")
    out = (queries
           .join(in_country, (qk == F.col("_prefix")) & (F.col(q_country) == F.col("_cty")), "left")
           .drop("_prefix", "_cty")
           .join(best, qk == F.col("_prefix2"), "left").drop("_prefix2"))
    return (out.withColumn("resolved_id", F.coalesce("_id_in", "_id_any"))
               .withColumn("match_type", F.when(F.col("_id_in").isNotNull(), F.lit("in_country"))
                           .when(F.col("_id_any").isNotNull(), F.lit("any_country"))
                           .otherwise(F.lit("not_found")))
               .drop("_id_in", "_id_any"))


def lookup_ci(df: DataFrame, col: str, dim: DataFrame, dim_name: str, dim_id: str, out: str) -> DataFrame:
    """Case-insensitive name → id. Names that are equal after lower() count once, with their
    smallest id, so no row is doubled."""
    d = dim.groupBy(F.lower(F.col(dim_name)).alias("_k")).agg(F.min(dim_id).alias(out))
    return df.join(d, F.lower(F.col(col)) == F.col("_k"), "left").drop("_k")


def has_child(parents: DataFrame, key: str, children: DataFrame, child_key: str, out: str) -> DataFrame:
    """Existence flag = left join to the DISTINCT child keys (no fan-out)."""
    ck = children.select(F.col(child_key).alias("_ck")).distinct().withColumn("_hit", F.lit(True))
    return (parents.join(ck, F.col(key) == F.col("_ck"), "left")
            .withColumn(out, F.coalesce(F.col("_hit"), F.lit(False))).drop("_ck", "_hit"))


def dedupe_dimension(dim: DataFrame, key: str, sentinel=None) -> DataFrame:
    """Q24: sentinel ids → null, then one row per id (smallest row wins) before a left join."""
    k = F.col(key)
    if sentinel is not None:
        dim = dim.withColumn(key, F.when(k == F.lit(sentinel), F.lit(None)).otherwise(k))
    dim = dim.where(F.col(key).isNotNull())
    cols = [c for c in dim.columns if c != key]
    return dim.groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select(key, "_r.*")


def md5_bucket(key: Column, buckets: int) -> Column:
    """Stable bucket from md5 of the key's string form (identical in DuckDB, partition-free)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def stable_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Exactly ``n`` rows chosen by hash of the key (top-k per task, then merged)."""
    return df.withColumn("_h", F.md5(key.cast("string"))).orderBy("_h").limit(n).drop("_h")


def hash_split(df: DataFrame, key: Column, test_fraction: float, buckets: int = 1000) -> DataFrame:
    """Deterministic train/test split by key hash; stable under any repartitioning."""
    cut = int(round(test_fraction * buckets))
    return df.withColumn("split", F.when(md5_bucket(key, buckets) < cut, F.lit("test")).otherwise(F.lit("train")))


def forward_fill(df: DataFrame, col: str, partition: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Last non-null value so far within each partition (explicit partition and order)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.col(col), ignorenulls=True).over(w))
