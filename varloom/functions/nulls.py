"""Null distributions of rank tests of small groups, with ties, and weights of resamples; NumPy on arrays of bounded size."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: A prime below 2^31, and how many of its residues are at least k for a Poisson number with mean 1.
PRIME = 2**31 - 1
STEPS = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(13))


def subset_sums(parts: np.ndarray, size: int) -> np.ndarray:
    """How many subsets of ``size`` of the whole numbers ``parts`` have each sum."""
    ways = np.zeros((size + 1, int(parts.sum()) + 1))
    ways[0, 0] = 1
    for p in parts.tolist():
        ways[1:, p:] += ways[:-1, : ways.shape[1] - p].copy()
    return ways[size]


def any_subset_sums(parts: np.ndarray) -> np.ndarray:
    """How many subsets of the whole numbers ``parts`` have each sum."""
    ways = np.zeros(int(parts.sum()) + 1)
    ways[0] = 1
    for p in parts.tolist():
        ways[p:] += ways[: len(ways) - p].copy()
    return ways


def two_sided(ways: np.ndarray, at: int) -> float:
    """Twice the smaller of both tails that hold ``at``, 1 at the most."""
    return float(min(1.0, 2 * min(ways[: at + 1].sum(), ways[at:].sum()) / ways.sum()))


def rank_sum_p(twice_ranks: np.ndarray, first: np.ndarray) -> float:
    """Exact p of the rank sum of the rows of ``first``, given all rows' ranks, doubled so that those of ties are whole."""
    return two_sided(subset_sums(twice_ranks, int(first.sum())), int(twice_ranks[first].sum()))


def signed_rank_p(twice_ranks: np.ndarray, positive: np.ndarray) -> float:
    """Exact p of the sum of the ranks of positive differences, given all ranks of absolute differences, doubled."""
    return two_sided(any_subset_sums(twice_ranks), int(twice_ranks[positive].sum()))


def ks_p(a: np.ndarray, b: np.ndarray) -> float:
    """Exact p of the largest difference of two empirical distributions, given the rows of either group at each value in order.

    Orders of the rows are lattice paths; those that stay nearer than the observed difference wherever a value ends are counted.
    """
    n, m = int(a.sum()), int(b.sum())
    ends = np.cumsum(a + b)
    least = np.abs(np.cumsum(a) * m - np.cumsum(b) * n).max()  # differences times n * m are whole
    paths = np.zeros(n + 1)
    paths[0] = 1
    judged = np.zeros(n + m + 1, bool)
    judged[ends] = True
    i = np.arange(n + 1)
    for t in range(1, n + m + 1):
        paths[1:] += paths[:-1].copy()
        paths[(i > t) | (t - i > m)] = 0
        if judged[t]:
            paths[np.abs(i * m - (t - i) * n) >= least] = 0
    return float(min(1.0, max(0.0, 1 - paths[n] / math.comb(n + m, n)))) if least else 1.0


def round_factors(seed: int, rounds: int) -> np.ndarray:
    """Two numbers below ``PRIME`` for each round, from 1 on: a factor and a shift."""
    number = lambda b, what: int(hashlib.md5(f"{seed}|{b}|{what}".encode()).hexdigest()[:8], 16)
    return np.array([(number(b, "a") % (PRIME - 1) + 1, number(b, "b") % PRIME) for b in range(1, rounds + 1)], np.int64).reshape(-1, 2)


def resample_weights(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """How often each row, told by a number x below ``PRIME``, is drawn in each round: Poisson with mean 1.  Round 0 has all rows once."""
    out = np.ones((len(factors) + 1, len(x)), np.int64)
    out[1:] = np.searchsorted(STEPS, (factors[:, :1] * x + factors[:, 1:]) % PRIME, "right")
    return out


def between(stat: str, n: np.ndarray, trim: float) -> tuple[np.ndarray, np.ndarray]:
    """The places, among n values in order, of those whose mean is the statistic."""
    if stat == "mean":
        return np.ones_like(n), n
    if stat == "median":
        return (n + 1) // 2, n // 2 + 1
    low = np.floor(n * trim).astype(np.int64) + 1
    return low, n + 1 - low


def placed_sums(v: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row of ``weights`` the sum of v, in order and as often as it says, over the places ``low`` to ``high``."""
    upto = np.cumsum(weights, axis=1)
    inside = np.minimum(upto, high[:, None]) - np.maximum(upto - weights, low[:, None] - 1)
    return np.maximum(inside, 0) @ v


def hashed_order(names: list[bytes], seed: int, round_: int) -> np.ndarray:
    """The order of ``names`` by the md5 of seed, round and name; equal ones stay in order."""
    head = b"%d|%d" % (seed, round_)
    digests = np.frombuffer(b"".join(hashlib.md5(head + name).digest() for name in names), ">u8").reshape(-1, 2)
    return np.lexsort((digests[:, 1], digests[:, 0]))


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson correlation over the pairs without NaN; NaN where a side is constant."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if not len(x):
        return math.nan
    x, y = x - np.median(x), y - np.median(y)  # a constant side is exactly 0
    x, y = x - x.mean(), y - y.mean()
    return cosine(x, y)


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine over the pairs without NaN; NaN where a side has no length."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    length = math.sqrt(float(x @ x) * float(y @ y))
    return float(x @ y) / length if length else math.nan
