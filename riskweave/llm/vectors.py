"""Vector tables for the search operators: valid rows, and distinct values with their smallest ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_STEP = 20  # queries are the rows whose id is divisible by this


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows that take part. Left out: null ids, vectors that are null, zero, or hold null or
    non-finite components, and vectors of another length than most have (ties: the longer)."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull())
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("vec") == (usual.n if usual else 0))


def distinct_with_ids(rows: DataFrame, value: str, ids: int) -> DataFrame:
    """One row per distinct value with its ``ids`` smallest ids, ascending. No search that returns fewer
    neighbours can need more of them: equal values are equally near, and ties go to the smaller id. The limit
    applies before the shuffle too, so a value that many rows share costs few rows per task."""
    w = Window.partitionBy(value).orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= ids)
    return few.groupBy(value).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def expand_neighbours(found: DataFrame, queries: DataFrame, k: int, best_first, measure: str) -> DataFrame:
    """``found``: (q, measure, ids) candidates of distinct query values; ``queries``: (query_id, q). Each
    query's ``k`` nearest without itself, ties to the smaller id: query_id, rank, vec_id and the measure."""
    ids = found.select("q", measure, F.explode("ids").alias("vec_id"))
    top = ids.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(best_first, "vec_id"))).where(F.col("_r") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", measure))).alias("_all"))  # k + 1 at most
    own = queries.join(lists, "q").select("query_id", F.slice(F.filter("_all", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("_top"))
    out = own.select("query_id", F.posexplode("_top").alias("_p", "_x"))
    return out.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col(f"_x.{measure}").alias(measure))
