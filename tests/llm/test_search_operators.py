"""Nearest neighbours (recall, exact scores) and Hamming top-k (exact) against brute force."""

import math

import numpy as np
import pytest

from riskweave.llm import hamming as H
from riskweave.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, q string, ids string, cell int, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q", "i", 1, "c") for i, v in rows], SCHEMA)


def vectors(n=1500, d=16, seed=0, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, d))
    x = (centre[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, d))).astype(np.float32)
    x[200:700] = x[100]  # a third are one vector
    x[700:720] = x[720:740] * 3  # norms differ
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


ODD = [(5000, None), (5020, [0.0] * 16), (5040, [1.0] * 15 + [None]), (5060, [float("nan")] + [1.0] * 15), (5080, [math.inf] + [1.0] * 15),
       (5100, [1.0] * 3), (5120, []), (None, [1.0] * 16), (40, None)]


def brute(rows, score, k=20):
    real = [(i, v) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and all(map(math.isfinite, v)) and any(v)]
    real = list({(i, tuple(v)) for i, v in real})
    out = {}
    for q, x in real:
        if q % 20 == 0:
            near = sorted(((score(x, v), i) for i, v in real if i != q), key=lambda t: t)[:k]
            out[q] = near
    return out


def inner(x, y):
    return -float(np.dot(np.array(x, np.float32).astype(np.float64), np.array(y, np.float32).astype(np.float64)))


def bits(x, y):
    return sum((a >= 0) != (b >= 0) for a, b in zip(x, y, strict=True))


def lists(got, measure):
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r[measure]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("cell_rows", [N.CELL_ROWS, 60])
def test_nearest_recall_and_scores(spark, cell_rows):
    rows = vectors() + ODD + [(60, vectors()[60][1])]
    got = lists(N.nearest(table(spark, rows), cell_rows=cell_rows).collect(), "score")
    want = brute(rows, inner)
    assert set(got) == set(want)
    by_id = dict(vectors())
    hits = 0
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21)) and q not in {i for _, i, _ in near}
        assert all(s == pytest.approx(-inner(by_id[q], by_id[i]), abs=1e-9) for _, i, s in near)
        assert [(-round(s, 9), i) for _, i, s in near] == sorted((-round(s, 9), i) for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for _, i in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_recall_on_the_test_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    got = lists(N.nearest(t, cell_rows=64).collect(), "score")
    hits = total = 0
    for j in np.flatnonzero(ids % 20 == 0):
        s = x @ x[j]
        s[j] = -9
        want = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len({i for _, i, _ in got[ids[j]]} & set(want.tolist())), total + 20
    assert hits >= 0.9 * total


def test_few_or_no_vectors(spark):
    assert N.nearest(table(spark, [])).count() == 0
    assert N.nearest(table(spark, ODD[:2])).count() == 0
    assert N.nearest(table(spark, [(0, [1.0, 0.0])])).count() == 0
    got = N.nearest(table(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 2, 2.0), (0, 2, 1, 1.0)]
    assert H.hamming_top_k(H.sign_codes(table(spark, []))).count() == 0
    got = H.hamming_top_k(H.sign_codes(table(spark, [(0, [1.0, 0.0]), (1, [1.0, -1.0]), (2, [2.0, 1.0])]))).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 2, 0), (0, 2, 1, 1)]


@pytest.mark.parametrize("codes,queries", [(H.BLOCK_CODES, H.BLOCK_QUERIES), (100, 7)])
def test_hamming_is_exact(spark, monkeypatch, codes, queries):
    monkeypatch.setattr(H, "BLOCK_CODES", codes)
    monkeypatch.setattr(H, "BLOCK_QUERIES", queries)
    rows = vectors() + ODD + [(60, vectors()[60][1])]
    got = lists(H.hamming_top_k(H.sign_codes(table(spark, rows))).collect(), "distance")
    want = brute(rows, bits)
    assert got == {q: [(r, i, d) for r, (d, i) in enumerate(near, 1)] for q, near in want.items()}


def test_hamming_far_codes_need_large_radii(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)] + [(None, 3), (7, None)], "id long, code long")
    got = lists(H.hamming_top_k(df, k=5).collect(), "distance")
    u = codes.view(np.uint64)
    for q in range(0, 300, 20):
        d = np.bitwise_count(u ^ u[q]).astype(int)
        want = sorted((int(d[i]), i) for i in range(300) if i != q)[:5]
        assert [(x, i) for _, i, x in got[q]] == want


def test_chi_square_quantile():
    assert N.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
