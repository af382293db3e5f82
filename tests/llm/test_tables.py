"""Numbers of tables of dishes with many customers against the recursion of the Stirling numbers."""

import math
import tracemalloc

import numpy as np
import pytest

from textloom.llm import pitman_yor


def weights(d, c, a):
    """Over t = 1..c, from the recursion on one row."""
    row, t = np.array([0.0]), np.arange(1, c + 1)
    for n in range(1, c):
        stay = np.append(np.log(n - d * t[:n]) + row, -np.inf)
        row = np.logaddexp(stay, np.append(-np.inf, row))
    w = row + t * math.log(a)
    w = np.exp(w - w.max())
    return row, w / w.sum()


@pytest.mark.parametrize(("d", "a", "c"), [(0.8, 5, 2000), (0.5, 5, 300), (0.8, 50, 2000), (0.5, 0.001, 1500), (0.05, 3, 800), (0.95, 40, 700), (0.5, 3000, 1000)])
def test_many_customers(d, a, c):
    row, w = weights(d, c, a)
    some = np.array(sorted({1, 2, 3, 5, 20, 100, c // 2}), float)
    got = pitman_yor.log_power_term(d, np.full(len(some), float(c)), some) + math.lgamma(c + 1) - np.array([math.lgamma(t + 1) for t in some])
    assert np.abs(got - row[some.astype(int) - 1]).max() < 1e-5
    t, n = np.arange(1, c + 1), 4000
    mean = (w * t).sum()
    sd = math.sqrt((w * (t - mean) ** 2).sum())
    drawn = pitman_yor.sample_tables(np.full(n, c), np.full(n, float(a)), d, pitman_yor.log_stirling(d, pitman_yor.EXACT), np.random.default_rng(3))
    assert abs(drawn.mean() - mean) < 5 * sd / math.sqrt(n) + 1e-3 and abs(drawn.std() - sd) < 0.1 * sd + 0.03
    print(d, a, c, "mean", round(mean, 2), "sd", round(sd, 2), "drawn", drawn.mean(), drawn.std(), "largest error", np.abs(got - row[some.astype(int) - 1]).max())


def test_seatings_memory():
    """Pairs of one customer are not drawn: a sweep over a bucket of such pairs takes few bytes for each."""
    n, words = 400_000, 1000
    counts = np.ones(n, np.int64)
    counts[::50] = 3
    per_word, contexts = np.full(words, n // words), np.arange(n, dtype=np.uint32) % 5000
    state = {"seed": 1, "d": 0.5, "d_root": 0.5, "strength": 1.0, "sums": [n, n], "stirling": pitman_yor.log_stirling(0.5, 4)}
    totals = [np.bincount(contexts).astype(np.int64)] * 2
    tracemalloc.start()
    for t, root in pitman_yor._seatings(0, per_word, contexts, counts, totals, state):  # noqa: B007
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * n
    assert (t[counts == 1] == 1).all() and set(t[counts == 3]) <= {1, 2, 3} and len(set(t[counts == 3])) > 1
    assert (root == t.reshape(words, -1).sum(axis=1)).all()
