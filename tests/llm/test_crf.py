"""Forward-backward against the enumeration of all label paths."""
import itertools

import numpy as np
import pytest

from finlake.llm import crf


def enumerated(score, transition):
    """Marginals of one sequence and its expected transition counts, path by path."""
    n, states = score.shape
    paths = list(itertools.product(range(states), repeat=n))
    weight = np.array([sum(score[i, s] for i, s in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:])) for p in paths])
    weight = np.exp(weight - weight.max())
    weight /= weight.sum()
    out, counts = np.zeros((n, states)), np.zeros((states, states))
    for p, w in zip(paths, weight):
        for i, s in enumerate(p):
            out[i, s] += w
        for a, b in zip(p, p[1:]):
            counts[a, b] += w
    return out, counts


@pytest.mark.parametrize("states", [2, 3])
@pytest.mark.parametrize("spread", [0.1, 3.0, 30.0])
def test_marginals_equal_all_paths(states, spread):
    rng = np.random.default_rng(states)
    length = [3, 0, 1, 6, 6, 2, 0]  # empty sequences, ties, a single item
    first = np.concatenate([[0], np.cumsum(length)])
    score, transition = rng.normal(0, spread, (first[-1], states)), rng.normal(0, min(spread, 5), (states, states))
    got, counts = crf.marginals(score, first, transition)
    want = [enumerated(score[a:b], transition) for a, b in zip(first[:-1], first[1:]) if b > a]
    assert np.allclose(got, np.concatenate([w[0] for w in want]), atol=1e-9)
    assert np.allclose(counts, sum(w[1] for w in want), atol=1e-9)


def test_no_items():
    out, counts = crf.marginals(np.zeros((0, 2)), np.array([0, 0]), np.zeros((2, 2)))
    assert out.shape == (0, 2) and not counts.any()
