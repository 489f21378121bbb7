"""Steps that hold or shuffle no more than they have to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from viewmint.operators import coded as D
from viewmint.operators import text_vectors as V
from viewmint.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pools_of_titles_are_not_shuffled(spark):
    assert "pool" not in _plan(QUERIES["ctl_degree_titles"](spark, SMALL))


def test_a_cell_gives_k_rows_a_query():
    """Scores by hand: the cell's and one product a part."""
    rng = np.random.default_rng(5)
    codes, products, base = rng.integers(0, 4, (300, 2)), rng.normal(size=(150, 8)), rng.normal(size=150)
    rows = pa.table({"did": np.arange(300)[::-1].copy(), "codes": pa.array(list(codes.astype(np.int32)))})
    asked = pa.table({"qid": np.arange(150), "base": base, "products": pa.array(list(products))})
    met = D._met(3, 4)(rows, asked).to_pydict()
    score = np.round(base[:, None] + (products[:, codes[:, 0]] + products[:, 4 + codes[:, 1]]), 9)
    want = []
    for q in range(150):
        order = sorted((-score[q, r], 299 - r) for r in range(300) if 299 - r != q)[:3]
        want += [(q, d, -s) for s, d in order]
    assert list(zip(met["qid"], met["did"], met["score"])) == want


def test_pairs_of_a_coded_search_are_not_sorted_by_the_jvm(spark):
    plan = _plan(QUERIES["knn_ivfpq"](spark, SMALL))
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(products" not in plan


def test_blocks_take_no_python_lists():
    """Rows are filled from Arrow's own buffers, also of a part of a batch."""
    batch = pa.record_batch({"bucket": pa.array([[7], [], [0, 2], [1]], pa.list_(pa.int32())), "weight": pa.array([[9.0], [], [0.5, 0.25], [1.0]], pa.list_(pa.float64()))}).slice(1)
    (dense,) = V._blocks(batch, 0, 4)
    assert dense.tolist() == [[0, 0, 0, 0], [0.5, 0, 0.25, 0], [0, 1, 0, 0]]
    assert "to_pylist" not in V._blocks.__code__.co_names
