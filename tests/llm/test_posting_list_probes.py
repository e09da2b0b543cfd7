"""Probes of an index with more lists than a beam is wide."""

import numpy as np
from glyphward.llm import posting_lists


def test_the_ratio_alone_decides():
    rng = np.random.default_rng(4)
    unit = posting_lists.unit_rows(rng.normal(size=(2000, 16)))
    index = posting_lists.fit(unit, len(unit), 10)
    k = len(index.centroids)
    assert k > 2 * posting_lists.QUERY_BEAM
    row, to, first = index.lists(unit[:50], 1e9)
    assert sorted(zip(row.tolist(), to.tolist(), strict=True)) == [(i, j) for i in range(50) for j in range(k)]
    far = index.distances(unit[:50])
    assert sorted(zip(row[first].tolist(), to[first].tolist(), strict=True)) == list(enumerate(far.argmin(axis=1).tolist()))
    row, to, _ = index.lists(unit[:50], 1.6)
    expected = far <= 1.6 * far.min(axis=1, keepdims=True)
    assert expected.sum(axis=1).max() > posting_lists.QUERY_BEAM
    missing = set(zip(*map(list, np.nonzero(expected)), strict=True)) - set(zip(row.tolist(), to.tolist(), strict=True))
    assert len(missing) < 0.01 * expected.sum()


def test_further_lists_until_enough_vectors():
    rng = np.random.default_rng(5)
    unit = posting_lists.unit_rows(rng.normal(size=(2000, 16)))
    index = posting_lists.fit(unit, len(unit), 10)
    sizes = np.zeros(len(index.centroids), int)
    sizes[[3, 150]] = 4, 2
    row, to, _ = index.lists(unit[:20], 1.0, None, sizes, 6)
    assert all(sizes[to[row == i]].sum() == 6 for i in range(20))
