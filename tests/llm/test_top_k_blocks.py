"""The queries that meet in a block are held against it together."""

import numpy as np
import pytest

from cyclewise.llm import topk


class Counted(np.ndarray):
    """Counts the matrix products it takes part in."""
    products = 0

    def __rmatmul__(self, other):
        Counted.products += 1
        return np.asarray(other) @ np.asarray(self)


@pytest.mark.parametrize("exact", [np.float32, np.float64, np.int64])
def test_search_is_that_of_all_rows_in_few_products(exact):
    draw = np.random.default_rng(2)
    vectors = draw.integers(-9, 9, size=(700, 6))
    ids = draw.permutation(650).repeat(2)[:700].astype(np.int64)  # ids that repeat, others left out
    pivots = vectors[:5].astype(float)
    table = topk.distances(vectors.astype(float), pivots)
    block = topk.Block(ids, vectors, table, exact)
    block.v = block.v.view(Counted)
    Counted.products = 0
    pick = np.arange(0, 700, 3)
    least = np.where(pick % 2, 60.0, -np.inf)
    rows, found, score = topk.search(vectors[pick], ids[pick], table[pick], least, block, 4,
                                     float(np.linalg.norm(pivots, axis=1).max()))
    for r, i in enumerate(pick):
        all_scores = [(-int(vectors[i] @ c), int(j)) for c, j in zip(vectors, ids) if j != ids[i]]
        want = sorted(x for x in all_scores if -x[0] >= least[r])[:4]
        assert sorted((-int(s), int(j)) for s, j, q in zip(score, found, rows) if q == r) == want
    assert Counted.products <= len(block.starts)
