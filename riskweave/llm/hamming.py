"""Exact top-k search of binary codes (operator 9): incremental multi-index hashing.

A code is one 64-bit word or several; each word is cut into 4 segments of 16. Codes of S segments that differ in D bits
have a segment that differs in at most D / S. A query looks up, segment by segment, all segment values at radius 0, then
1, and so on, and verifies the codes it meets; once segments 0 to s are done at radius r (the others at r - 1), every
code within S r + s bits has been met.
It stops when its k-th verified distance is within that bound, which proves the result exact, ties included.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import parallelism
from riskweave.llm.vectors import QUERY_STEP, distinct_with_ids, expand_neighbours, valid_vectors
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

SEGMENTS, SEGMENT_BITS = 4, 16  # of one word
BLOCK_CODES = 1 << 18  # codes that one task indexes
BLOCK_QUERIES = 1 << 14  # queries that one task answers

_VALUES = np.arange(1 << SEGMENT_BITS, dtype=np.uint32)
_MASKS = [_VALUES[np.bitwise_count(_VALUES) == r] for r in range(SEGMENT_BITS + 1)]


class MultiIndex:
    """Distinct codes (a row of 64-bit words each) with the number of rows each stands for."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.codes, self.weights = codes, weights
        self.tables, self.segments = [], SEGMENTS * codes.shape[1]
        for s in range(self.segments):
            seg = self._segment(codes, s)
            order = np.argsort(seg, kind="stable")
            upto = np.concatenate([[0], np.cumsum(np.bincount(seg, minlength=1 << SEGMENT_BITS))])
            self.tables.append((order, upto, np.unique(seg)))
        self.seen = np.zeros(len(codes), dtype=bool)

    @staticmethod
    def _segment(codes, s: int):
        word, place = divmod(s, SEGMENTS)
        return (codes[..., word] >> np.uint64(SEGMENT_BITS * place) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.uint32)

    def _meet(self, s: int, value: np.uint32, radius: int) -> np.ndarray:
        """Codes whose segment s is exactly ``radius`` bits from ``value`` and that were not met before."""
        order, upto, present = self.tables[s]
        if len(_MASKS[radius]) <= len(present):
            v = value ^ _MASKS[radius]
        else:  # fewer values occur than masks exist
            v = present[np.bitwise_count(present ^ value) == radius]
        start, n = upto[v], upto[v + 1] - upto[v]
        total = int(n.sum())
        rows = order[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)]
        rows = rows[~self.seen[rows]]
        self.seen[rows] = True
        return rows

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances of all codes up to the distance within which ``k`` rows lie (all, if fewer)."""
        met, far = [], []
        most = self.segments * SEGMENT_BITS
        within = np.zeros(most + 2, dtype=np.int64)  # rows verified, by distance
        stop = most + 1
        for radius in range(SEGMENT_BITS + 1):
            for s in range(self.segments):
                rows = self._meet(s, self._segment(code, s), radius)
                d = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
                met.append(rows)
                far.append(d)
                within += np.bincount(d, weights=self.weights[rows], minlength=most + 2).astype(np.int64)
                enough = np.flatnonzero(np.cumsum(within) >= k)
                if len(enough) and enough[0] <= self.segments * radius + s:
                    stop = int(enough[0])
                    break
            else:
                continue
            break
        rows, d = np.concatenate(met), np.concatenate(far)
        self.seen[rows] = False
        inside = d <= stop
        return rows[inside], d[inside]


def hamming_top_k(rows: DataFrame, k: int = 20, query_step: int = QUERY_STEP) -> DataFrame:
    """``rows``: (id long, code), codes of one 64-bit word (long) or several (array<long>, all as many). query_id, rank (from 1), vec_id, distance of each query's ``k``
    nearest other rows, ties to the smaller id; queries are the rows whose id is divisible by ``query_step``. Null ids
    and codes take no part; rows repeated whole count once; fewer than k other rows: all of them; none: no rows.

    Distinct codes (with their k + 1 smallest ids) are dealt to blocks by hash and distinct query codes to groups; a
    task indexes one block and answers one group, and each query's lists of all blocks are merged."""
    spark = rows.sparkSession
    rows = rows.where(F.col("id").isNotNull() & F.col("code").isNotNull()).distinct()
    if dict(rows.dtypes)["code"] == "bigint":
        rows = rows.withColumn("code", F.array("code"))
    codes = stage(spark, distinct_with_ids(rows, "code", k + 1), "hamming_codes")
    queries = stage(spark, rows.where(F.col("id") % query_step == 0).select(F.col("id").alias("query_id"), F.col("code").alias("q")), "hamming_queries")
    asked = queries.select("q").distinct()
    n_codes, n_asked = codes.count(), asked.count()
    blocks = max(1, math.ceil(n_codes / BLOCK_CODES))
    groups = max(1, math.ceil(n_asked / BLOCK_QUERIES), math.ceil(parallelism(rows) / blocks))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    data = codes.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), every(groups).alias("group"))
    ask = asked.select("q", F.pmod(F.xxhash64("q"), F.lit(groups)).alias("group"), every(blocks).alias("block"))

    def answer(block: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(qs):
            return pd.DataFrame({"q": pd.Series(dtype=object), "distance": pd.Series(dtype=np.int32), "ids": pd.Series(dtype=object)})
        ids = block.ids.to_numpy()
        index = MultiIndex(np.stack(block.code.to_numpy()).astype(np.int64).view(np.uint64), np.array([len(i) for i in ids]))
        first = np.array([i[0] for i in ids])
        q_out, d_out, i_out = [], [], []
        for q in qs.q.to_numpy():
            found, d = index.search(np.asarray(q, dtype=np.int64).view(np.uint64), k + 1)
            best = np.lexsort((first[found], d))[:k + 1]
            q_out += [q] * len(best)
            d_out.append(d[best])
            i_out += [list(ids[j]) for j in found[best]]
        return pd.DataFrame({"q": q_out, "distance": np.concatenate(d_out).astype(np.int32), "ids": i_out})

    found = data.groupBy("block", "group").cogroup(ask.groupBy("block", "group")).applyInPandas(answer, "q array<long>, distance int, ids array<long>")
    return expand_neighbours(found, queries, k, F.asc("distance"), "distance")


def sign_codes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code): one bit per component, 1 where it is at least 0, 64 components per word. Vectors that
    ``valid_vectors`` leaves out have no code."""
    def word(i):
        return F.aggregate(F.slice("vec", i * 64 + 1, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x >= 0).cast("long")))
    words = F.transform(F.sequence(F.lit(0), F.expr("(size(vec) - 1) div 64").cast("int")), word)
    return valid_vectors(table, id_col, vec_col).select("id", words.alias("code"))


_SQL = """
WITH v AS (SELECT vec_id, [CASE WHEN x >= 0 THEN 1 ELSE 0 END FOR x IN embedding] AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.c, b.c)]) AS INTEGER) AS distance
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 20
"""


@register("op9_hamming_top_k", _SQL)
def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_top_k(sign_codes(read_table(spark, sf_dir, "embeddings")))
