"""Hamming search over vectors of more than 64 components, against all pairs."""

import numpy as np
import pytest
from test_search_operators import bits, lists, table

from riskweave.llm import hamming as H


@pytest.mark.parametrize("d", [65, 150])
def test_more_than_one_word(spark, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((8, d))[rng.integers(0, 8, 300)] + 0.8 * rng.standard_normal((300, d))
    x[1::2, -64:] = x[0, -64:]  # the last 64 components alone do not tell half of them apart
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = lists(H.hamming_top_k(H.sign_codes(table(spark, rows))).collect(), "distance")
    assert set(got) == set(range(0, 300, 20))
    for q, near in got.items():
        want = sorted((bits(rows[q][1], v), i) for i, v in rows if i != q)[:20]
        assert [(m, i) for _, i, m in near] == want
