"""The driver fits the voter to rows that it reads some at a time."""

import tracemalloc

import numpy as np

from lexforest.llm import quality


def test_fit_holds_few_rows_and_finds_the_singular_vectors():
    draw = np.random.default_rng(4)
    x = (draw.random((4096, 60), np.float32) @ draw.random((60, quality.N_TERMS), np.float32)).astype(np.float32)
    labels = draw.integers(0, 2, len(x))
    tracemalloc.start()
    voter = quality.Voter.fit(lambda: (x[a : a + quality.FIT_BLOCK] for a in range(0, len(x), quality.FIT_BLOCK)), labels, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # four squares of the terms; the rows once more and their decomposition took over 100 MB
    assert peak < 4.5 * 8 * quality.N_TERMS**2
    want = np.linalg.svd((x - x.mean(0)).astype(np.float64), full_matrices=False)[2][:8]
    assert np.abs((voter.basis[:, :8] * want.T).sum(0)).min() > 0.999
    assert voter.vectors.shape == (4096, 48) and np.allclose(voter.vectors, voter.latent(x), atol=1e-5)


def test_fewer_rows_than_ranks():
    x = np.eye(3, quality.N_TERMS, dtype=np.float32)
    voter = quality.Voter.fit(lambda: iter([x]), np.array([0, 1, 1]), 48)
    assert np.isfinite(voter.vote(x, np.array([9, 9, 9]), 15)).all()
