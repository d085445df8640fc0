"""Approximate nearest neighbours (operator 3): stable projections, a kd-tree, and a chi-square stopping test.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm
(0 for queries). A Gaussian (2-stable) projection to ``M_DIMS`` dimensions keeps distances in distribution: projected
squared distance / squared distance is chi-square with ``M_DIMS`` degrees of freedom. A kd-tree over projected points
deals all vectors to cells; in a cell, a smaller kd-tree gives its leaves in order of projected distance. A search
verifies original vectors leaf by leaf and stops where the next leaf is so far in projection that a nearer vector than
the k-th verified one would project there with a chance below 1 - ``CONFIDENCE``. The first round searches a query's
own cell, which bounds its k-th distance; the second all other cells that the stopping radius still reaches. Cells
become more as the table grows; a task gets a bounded part of one cell's vectors and of the queries that reach it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import uniform_hash
from riskweave.llm.vectors import QUERY_STEP, distinct_with_ids, expand_neighbours, valid_vectors
from riskweave.plans.registry import register
from riskweave.sources.files import stage
from riskweave.sources.tables import read_table

M_DIMS = 8  # even, so that the chi-square distribution has a closed form
CONFIDENCE = 0.95
CELL_ROWS = 4096
SAMPLE_ROWS = 20_000  # the cells' tree is fitted on about so many projected vectors, or more (below); all are indexed
CELL_SAMPLE = 8  # projected vectors per cell that the tree is fitted on, at least
BLOCK_ROWS = 1 << 14  # vectors of a cell that one task searches, about
BLOCK_QUERIES = 1 << 14  # queries that it answers, about
LEAF_ROWS = 64
STEP_LEAVES = 8


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of ``dims`` (even) degrees <= x) = p."""
    def cdf(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Index(NamedTuple):
    projection: np.ndarray  # (dims + 1) x M_DIMS
    max_square: float
    axis: np.ndarray  # of the cells' tree, in heap order
    split: np.ndarray


def lifted(x: np.ndarray, max_square: float, query: bool) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(max_square - square, 0))
    return np.column_stack([x, last])


def project(index: Index, x: np.ndarray, query: bool) -> np.ndarray:
    return lifted(x, index.max_square, query) @ index.projection


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits along the widest axis, ``2**depth`` cells."""
    axis, split = np.zeros(2 ** depth, dtype=np.int64), np.zeros(2 ** depth)
    groups = {1: points}
    for node in range(1, 2 ** depth):
        p = groups.pop(node)
        if len(p):
            axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
            split[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] > split[node]
        groups[2 * node], groups[2 * node + 1] = p[~right], p[right]
    return axis, split


def cell_of(index: Index, points: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    for _ in range(int(np.log2(len(index.axis)))):
        node = 2 * node + (points[np.arange(len(points)), index.axis[node]] > index.split[node])
    return node - len(index.axis)


class Leaves:
    """A cell's points in kd-tree order, in leaves of at most LEAF_ROWS, with the leaves' boxes."""

    def __init__(self, points: np.ndarray):
        parts, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF_ROWS:
                parts.append(own)
                continue
            p = points[own]
            a = np.argmax(p.max(axis=0) - p.min(axis=0))
            half = len(own) // 2
            order = np.argpartition(p[:, a], half)
            todo += [own[order[:half]], own[order[half:]]]
        self.parts = parts
        self.low = np.stack([points[p].min(axis=0) for p in parts])
        self.high = np.stack([points[p].max(axis=0) for p in parts])

    def by_distance(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        square = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(square, kind="stable")
        return order, square[order]


def search_cell(index: Index, ids0: np.ndarray, vectors: np.ndarray, queries: np.ndarray, bounds: np.ndarray,
                k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query: row numbers and inner products of its verified best ``k`` (ties to smaller ``ids0``).
    ``bounds``: squared distances already known to have k vectors within."""
    points = project(index, vectors, False)
    leaves = Leaves(points)
    limit = chi_square_quantile(CONFIDENCE, index.projection.shape[1])
    flat = project(index, queries, True)
    square = np.einsum("ij,ij->i", queries, queries) + index.max_square
    out = []
    for q, qp, s, bound in zip(queries, flat, square, bounds, strict=True):
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        order, far = leaves.by_distance(qp)
        at = 0
        while at < len(order):
            upto = min(at + STEP_LEAVES, int(np.searchsorted(far, limit * bound, side="right")))
            if upto <= at:
                break
            near = np.concatenate([leaves.parts[i] for i in order[at:upto]])
            gap = points[near] - qp
            near = near[np.einsum("ij,ij->i", gap, gap) <= limit * bound]
            at = upto
            rows = np.concatenate([rows, near])
            scores = np.concatenate([scores, vectors[near] @ q])
            if len(rows) > k:
                best = np.lexsort((ids0[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows) >= k:
                bound = min(bound, max(float(s - 2 * scores.min()), 0.0))
        best = np.lexsort((ids0[rows], -scores))[:k]
        out.append((rows[best], scores[best]))
    return out


def _array(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(table: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            query_step: int = QUERY_STEP, cell_rows: int = CELL_ROWS, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product, double) of each query's ``k`` nearest found. Queries:
    rows whose id is divisible by ``query_step``; candidates: every other row. Rows that ``valid_vectors`` leaves out
    take no part; repeated ids count once per distinct vector; an empty table gives no rows."""
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vec_col).distinct()
    vectors = stage(spark, distinct_with_ids(rows, "vec", k + 1).withColumn("q", F.xxhash64(F.lit(seed), "vec", "ids")), "ann_vectors")
    queries = stage(spark, rows.where(F.col("id") % query_step == 0).join(vectors.select("vec", "q"), "vec")
                    .select(F.col("id").alias("query_id"), "q"), "ann_queries")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = vectors.agg(F.count("*").alias("n"), F.max(square).alias("m"), F.max(F.size("vec")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size.n:
        return spark.createDataFrame([], schema)
    projection = np.random.default_rng(seed).standard_normal((size.d + 1, M_DIMS))
    plain = Index(projection, size.m, np.zeros(1, dtype=np.int64), np.zeros(1))
    dims = range(M_DIMS)

    def flat(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame(project(plain, _array(f.vec), False), columns=[f"p{i}" for i in dims])

    want = max(SAMPLE_ROWS, CELL_SAMPLE * math.ceil(size.n / cell_rows))
    few = vectors.where(uniform_hash("q", seed=seed) * size.n < want).select("vec")
    sample = few.mapInPandas(flat, ", ".join(f"p{i} double" for i in dims)).toPandas().to_numpy(dtype=float)
    depth = max(0, min(math.ceil(math.log2(size.n / cell_rows)), int(math.log2(max(len(sample) // CELL_SAMPLE, 1)))))
    # A plain tuple: workers need not be able to import this module.
    shared = spark.sparkContext.broadcast((projection, size.m, *fit_tree(sample, depth)))

    def deal(is_query: bool):
        def run(frames):
            for f in frames:
                if len(f):
                    index = Index(*shared.value)
                    p = project(index, _array(f.vec), is_query)
                    f["cell"] = cell_of(index, p)
                    f["point"] = list(p)
                    yield f
        return run

    cells = stage(spark, vectors.mapInPandas(deal(False), "vec array<float>, ids array<long>, q long, cell long, point array<double>"), "ann_cells")
    asked = queries.select("q").distinct().join(vectors.select("q", "vec"), "q")
    asked = stage(spark, asked.mapInPandas(deal(True), "q long, vec array<float>, cell long, point array<double>"), "ann_asked")
    # One row per cell.
    boxes = cells.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("point")[i]).alias(f"{n}{i}") for i in dims for n, f in (("low", F.min), ("high", F.max))]).toPandas()
    number, low, high = boxes.cell.to_numpy(), boxes[[f"low{i}" for i in dims]].to_numpy(), boxes[[f"high{i}" for i in dims]].to_numpy()
    parts = np.ceil(boxes.n.to_numpy() / BLOCK_ROWS).astype(np.int64)
    data = cells.select("cell", "vec", "ids", "q")

    def search(data: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(qs):
            return pd.DataFrame({"q": pd.Series(dtype=np.int64), "ids": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        ids = data.ids.to_numpy()
        found = search_cell(Index(*shared.value), np.array([i[0] for i in ids]), _array(data.vec), _array(qs.vec), qs.bound.to_numpy(), k + 1)
        n = [len(r) for r, _ in found]
        return pd.DataFrame({"q": np.repeat(qs.q.to_numpy(), n), "ids": [list(ids[i]) for r, _ in found for i in r],
                             "score": np.concatenate([s for _, s in found])})

    out = "q long, ids array<long>, score double"

    def answers(asking: DataFrame, counts: pd.DataFrame) -> DataFrame:
        """Each query of ``asking`` in its cell. Rows of a cell are dealt to parts, its queries to slots (``counts``: cell,
        queries); every part meets every slot."""
        k_parts = pd.Series(parts, index=number)
        table_ = pd.DataFrame({"cell": counts.cell.astype(np.int64), "parts": k_parts.reindex(counts.cell).fillna(1).astype(np.int64).to_numpy(),
                               "slots": np.ceil(counts.queries.astype(float) / BLOCK_QUERIES).astype(np.int64)})
        if not len(table_):
            return spark.createDataFrame([], out)
        blocks = spark.createDataFrame(table_)

        def own(n):
            return F.pmod(F.xxhash64(F.lit(seed + 1), "q"), F.col(n))

        def every(n):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

        x = data.join(blocks, "cell").select("cell", "vec", "ids", own("parts").alias("part"), every("slots").alias("slot"))
        y = asking.join(blocks, "cell").select("q", "vec", "cell", "bound", own("slots").alias("slot"), every("parts").alias("part"))
        return x.groupBy("cell", "part", "slot").cogroup(y.groupBy("cell", "part", "slot")).applyInPandas(search, out)

    home = asked.select("q", "vec", "cell", F.lit(float("inf")).alias("bound"))
    first = stage(spark, answers(home, asked.groupBy("cell").agg(F.count("*").alias("queries")).toPandas()), "ann_home")
    # The k-th distance in the home cell (infinite where it holds fewer; one more than k, as the query is among them).
    kth = first.groupBy("q").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("least"))
    known = asked.join(kth, "q", "left").withColumn(
        "bound", F.when(F.col("n") > k, F.greatest(F.lit(0.0), square + F.lit(size.m) - 2 * F.col("least"))).otherwise(F.lit(float("inf"))))

    limit = chi_square_quantile(CONFIDENCE, M_DIMS)

    def reached(f):
        todo = []
        for p, cell, bound in zip(f.point, f.cell, f.bound, strict=True):
            gap = np.maximum(np.maximum(low - p, p - high), 0)
            todo.append(number[(np.einsum("ij,ij->i", gap, gap) <= limit * bound) & (number != cell)])
        return todo

    def count(frames):
        for f in frames:
            cell, queries_ = np.unique(np.concatenate([number[:0], *reached(f)]), return_counts=True)
            yield pd.DataFrame({"cell": cell, "queries": queries_})

    def reach(frames):
        for f in frames:
            todo = reached(f)
            n = np.array([len(t) for t in todo], dtype=np.int64)
            # A piece at a time: a query may reach most cells.
            for some in np.split(np.arange(len(f)), np.flatnonzero(np.diff(np.cumsum(n) // BLOCK_QUERIES)) + 1):
                if n[some].sum():
                    yield pd.DataFrame({"q": np.repeat(f.q.to_numpy()[some], n[some]), "vec": np.repeat(f.vec.to_numpy()[some], n[some]),
                                        "bound": np.repeat(f.bound.to_numpy()[some], n[some]), "cell": np.concatenate([todo[i] for i in some])})

    known = stage(spark, known.select("q", "vec", "cell", "point", "bound"), "ann_known")
    counts = known.mapInPandas(count, "cell long, queries long").groupBy("cell").agg(F.sum("queries").alias("queries")).toPandas()
    second = answers(known.mapInPandas(reach, "q long, vec array<float>, bound double, cell long"), counts)
    return expand_neighbours(first.unionByName(second), queries, k, F.desc("score"), "score")


@register("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
