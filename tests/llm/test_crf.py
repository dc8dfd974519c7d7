"""The linear-chain field against enumeration of all labellings."""

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from visitflow.llm import crf


def enumerated(model, scores, first):
    """Marginals and expected pairs over linked neighbours, by adding up the weights of all labellings of each chain."""
    n, size = scores.shape
    single, pairs = np.zeros((n, size)), np.zeros((size, size))
    begins = [*np.flatnonzero(first), n]
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        total, one, two = 0.0, np.zeros((b - a, size)), np.zeros((size, size))
        for labels in product(range(size), repeat=int(b - a)):
            weight = np.exp(model.start[labels[0]] + sum(scores[a + i, y] for i, y in enumerate(labels))
                            + sum(model.transitions[x, y] for x, y in zip(labels, labels[1:])))
            total += weight
            for i, y in enumerate(labels):
                one[i, y] += weight
            for x, y in zip(labels, labels[1:]):
                two[x, y] += weight
        single[a:b] = one / total
        pairs += two / total
    return single, pairs


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("size", [2, 3])
def test_marginals_and_pairs_equal_enumeration(size, block):
    random = np.random.default_rng(size)
    model = crf.Crf(list(range(size)), np.zeros((1, size)), random.normal(size=(size, size)) * 2, random.normal(size=size) * 2)
    scores = random.normal(size=(14, size)) * 3
    first = np.isin(np.arange(14), [0, 1, 6, 13])
    single, pairs = enumerated(model, scores, first)
    assert np.allclose(model.marginals(scores, first, block), single, atol=1e-12)
    ahead, behind = model.messages(scores, first, block)
    assert np.allclose(crf.expected_pairs(model, scores, ahead, behind, ~first[1:]), pairs, atol=1e-12)


def test_training_learns_transitions_and_starts():
    """Words say nothing; the first label is always 1 and labels alternate."""
    sequences, targets = [["w"] * 6] * 200, [[1, 0, 1, 0, 1, 0]] * 200
    model = crf.train(sequences, targets, [0, 1], epochs=30)
    scores = model.emissions(pa.array(["w"]))[[0] * 6]
    found = model.marginals(scores, np.arange(6) == 0)
    assert found.argmax(axis=1).tolist() == [1, 0, 1, 0, 1, 0] and found.max(axis=1).min() > 0.9
    assert model.start[1] > model.start[0] + 0.5
