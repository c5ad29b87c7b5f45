"""Discrete samplers as NumPy kernels, and a relational weighted draw.

Weights are non-negative; a state whose weight is 0 is never drawn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Sampler:
    """A distribution over numbered states."""

    def norm(self) -> float:
        raise NotImplementedError

    def weight(self, state: int) -> float:
        raise NotImplementedError

    def sample_from(self, u: float) -> int:
        """The state for a base value in [0, norm)."""
        raise NotImplementedError

    def sample(self, rng: np.random.Generator) -> int:
        return self.sample_from(rng.random() * self.norm())

    def update(self, state: int, weight: float) -> None:
        raise NotImplementedError

    def resample(self, rng: np.random.Generator, current: int, residual: float, tries: int = 3) -> int:
        """A draw; while it equals ``current`` it is drawn anew, unless kept with probability 1 - residual."""
        s = self.sample(rng)
        for _ in range(tries):
            if s != current or rng.random() >= residual:
                break
            s = self.sample(rng)
        return s


def _split(weights, states=None):
    w = np.asarray(weights, float)
    s = np.arange(len(w)) if states is None else np.asarray(states)
    keep = w > 0
    return w[keep], s[keep]


class FlatDist(Sampler):
    """Linear scan; O(1) update."""

    def __init__(self, weights, states=None):
        self.w, self.states = _split(weights, states)
        self.total = float(self.w.sum())

    def norm(self):
        return self.total

    def weight(self, state):
        return float(self.w[self.states == state].sum())

    def sample_from(self, u):
        return int(self.states[min(int(np.searchsorted(np.cumsum(self.w), u, "right")), len(self.w) - 1)])

    def update(self, state, weight):
        at = np.flatnonzero(self.states == state)
        if len(at):
            self.total += weight - self.w[at[0]]
            self.w[at[0]] = weight
        elif weight > 0:
            self.w, self.states = np.append(self.w, weight), np.append(self.states, state)
            self.total += weight


class CumulativeDist(Sampler):
    """Prefix sums and binary search; O(n) update."""

    def __init__(self, weights, states=None):
        self.w, self.states = _split(weights, states)
        self.cdf = np.cumsum(self.w)

    def norm(self):
        return float(self.cdf[-1]) if len(self.cdf) else 0.0

    def weight(self, state):
        return float(self.w[self.states == state].sum())

    def sample_from(self, u):
        return int(self.states[min(int(np.searchsorted(self.cdf, u, "right")), len(self.cdf) - 1)])

    def update(self, state, weight):
        at = np.flatnonzero(self.states == state)
        if len(at):
            self.w[at[0]] = weight
        else:
            self.w, self.states = np.append(self.w, weight), np.append(self.states, state)
        self.cdf = np.cumsum(self.w)


class AliasTable(Sampler):
    """O(n) build, O(1) draw.  Updates are ignored: the table may go stale on purpose."""

    def __init__(self, weights, states=None):
        self.w, self.states = _split(weights, states)
        n = len(self.w)
        self.total = float(self.w.sum())
        self.cut, self.alias = np.ones(n), np.arange(n)
        if not n:
            return
        p = self.w * n / self.total
        small, large = [k for k in range(n) if p[k] < 1], [k for k in range(n) if p[k] >= 1]
        while small and large:
            a, b = small.pop(), large.pop()
            self.cut[a], self.alias[a] = p[a], b
            p[b] -= 1 - p[a]
            (small if p[b] < 1 else large).append(b)

    def norm(self):
        return self.total

    def weight(self, state):
        return float(self.w[self.states == state].sum())

    def mass(self) -> np.ndarray:
        """The probability of each state that the table's cells imply."""
        out = self.cut.copy()
        np.add.at(out, self.alias, 1 - self.cut)
        return out / len(out)

    def sample_from(self, u):
        x = u / self.total * len(self.w)
        k = min(int(x), len(self.w) - 1)
        return int(self.states[k if x - k < self.cut[k] else self.alias[k]])

    def update(self, state, weight):
        pass

    def draw(self, rng: np.random.Generator, size: int) -> np.ndarray:
        """Many draws at once."""
        x = rng.random(size) * len(self.w)
        k = x.astype(int)
        return self.states[np.where(x - k < self.cut[k], k, self.alias[k])]


class FTree(Sampler):
    """A binary tree of sums over states 0 to n - 1: O(log n) draw and update; grows on demand."""

    def __init__(self, weights):
        self._build(np.asarray(weights, float))

    def _build(self, w: np.ndarray) -> None:
        self.leaves = 1
        while self.leaves < max(1, len(w)):
            self.leaves *= 2
        self.tree = np.zeros(2 * self.leaves)
        self.tree[self.leaves : self.leaves + len(w)] = np.maximum(w, 0)
        for k in range(self.leaves - 1, 0, -1):
            self.tree[k] = self.tree[2 * k] + self.tree[2 * k + 1]

    def norm(self):
        return float(self.tree[1])

    def weight(self, state):
        return float(self.tree[self.leaves + state]) if state < self.leaves else 0.0

    def sample_from(self, u):
        k = 1
        while k < self.leaves:
            k *= 2
            if u >= self.tree[k] and self.tree[k + 1] > 0:
                u -= self.tree[k]
                k += 1
        return k - self.leaves

    def update(self, state, weight):
        """A weight of 0 or less deletes the state."""
        if state >= self.leaves:
            self._build(np.append(self.tree[self.leaves :], np.zeros(state + 1 - self.leaves)))
        k = self.leaves + state
        self.tree[k] = max(weight, 0.0)
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] + self.tree[2 * k + 1]


class FTrees:
    """A tree of sums for each row of weights; all rows draw at once."""

    def __init__(self, weights: np.ndarray):
        rows, n = weights.shape
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.tree = np.zeros((rows, 2 * self.leaves))
        self.tree[:, self.leaves : self.leaves + n] = weights
        for k in range(self.leaves - 1, 0, -1):
            self.tree[:, k] = self.tree[:, 2 * k] + self.tree[:, 2 * k + 1]

    def norm(self) -> np.ndarray:
        return self.tree[:, 1]

    def sample_from(self, u: np.ndarray) -> np.ndarray:
        at, k, u = np.arange(len(u)), np.ones(len(u), np.int64), u.copy()
        for _ in range(self.leaves.bit_length() - 1):
            left = self.tree[at, 2 * k]
            right = (u >= left) & (self.tree[at, 2 * k + 1] > 0)
            u -= np.where(right, left, 0.0)
            k = 2 * k + right
        return k - self.leaves


class CompositeSampler(Sampler):
    """A mixture: a component by its norm, then a draw from it."""

    def __init__(self, *parts: Sampler):
        self.parts = parts

    def norm(self):
        return sum(p.norm() for p in self.parts)

    def weight(self, state):
        return sum(p.weight(state) for p in self.parts)

    def sample_from(self, u):
        for p in self.parts[:-1]:
            if u < p.norm():
                return p.sample_from(u)
            u -= p.norm()
        return self.parts[-1].sample_from(min(u, self.parts[-1].norm()))


def metropolis_hastings(current: int, proposed: int, target, proposal, u: float) -> int:
    """Accept with probability min(1, p(t') q(t) / (p(t) q(t')))."""
    if proposed == current:
        return current
    below = target(current) * proposal(proposed)
    return proposed if below <= 0 or u * below < target(proposed) * proposal(current) else current


def weighted_draw(weights: DataFrame, draws: DataFrame, keys: list[str], state: str = "state", weight: str = "weight", u: str = "u") -> DataFrame:
    """For each row of ``draws`` (keys and u in [0, 1)), the first state whose cumulative share exceeds u.

    A running sum over a key's states; each draw meets only its key's states.
    """
    w = Window.partitionBy(*keys).orderBy(state)
    cdf = weights.where(F.col(weight) > 0).select(
        *keys, F.col(state).alias("_s"), F.sum(weight).over(w).alias("_c"), F.sum(weight).over(Window.partitionBy(*keys)).alias("_t")
    )
    j = draws.join(cdf, keys).where(F.col("_c") > F.col(u) * F.col("_t"))
    return j.groupBy(*draws.columns).agg(F.min_by("_s", "_c").alias(state))
