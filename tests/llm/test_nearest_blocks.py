"""Nearest neighbours: no task gets a whole cell's vectors or queries, and cells become more with the table."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from test_search_operators import lists, table, vectors

from riskweave.llm import nearest as N

SEARCH = N.search_cell
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def small_only(index, ids0, vectors, queries, bounds, k):
    assert len(vectors) <= 250 and len(queries) <= 100, "unbounded group"
    return SEARCH(index, ids0, vectors, queries, bounds, k)


def enough_cells(index, ids0, vectors, queries, bounds, k):
    assert len(index.axis) >= 32, "cells do not grow"
    return SEARCH(index, ids0, vectors, queries, bounds, k)


@pytest.mark.parametrize("cell_rows,check", [(N.CELL_ROWS, small_only), (20, small_only), (20, enough_cells)])
def test_groups_are_bounded(spark, monkeypatch, cell_rows, check):
    for name, value in (("BLOCK_ROWS", 100), ("BLOCK_QUERIES", 30), ("SAMPLE_ROWS", 80), ("search_cell", check)):
        monkeypatch.setattr(N, name, value, raising=False)
    # More than half of 1500 are distinct; 3 of 4 ask, through ids that the query step divides.
    rows = [(20 * i if i % 4 else 20 * i + 1, v) for i, v in vectors()]
    got = lists(N.nearest(table(spark, rows), cell_rows=cell_rows).collect(), "score")
    assert len(got) == 1125 and all([r for r, _, _ in near] == list(range(1, 21)) for near in got.values())
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = 0
    for q in list(got)[::5]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -np.round(s, 9)))[:20]].tolist())
        hits += len({i for _, i, _ in got[q]} & best)
    assert hits >= 0.9 * 20 * len(list(got)[::5])
