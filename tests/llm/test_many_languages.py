"""Mixtures of more languages than four."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm.langid import mixtures


@pytest.mark.parametrize("n", [2, 5, 7])
def test_all_languages_of_a_document_stay(n):
    rng = np.random.default_rng(5)
    spoken = np.concatenate([np.repeat(np.arange(n), 60), np.zeros(50, np.int64)])
    words = np.full((len(spoken), 8), -30.0) - rng.random((len(spoken), 8))
    words[np.arange(len(spoken)), spoken] = -10.0
    share = mixtures(words, np.array([60 * n, 50]))
    assert np.allclose(share[0, :n], 1 / n, atol=0.01) and np.count_nonzero(share[0] > 1e-3) == n
    assert share[1, 0] == 1.0 and np.count_nonzero(share[1]) == 1
