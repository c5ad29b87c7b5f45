"""Gradient-based optimizers: losses and updaters on NumPy weights, data in Spark.

A gradient is computed batch-wise where the rows are (mapInPandas); each task
sends one partial sum, and the update is made on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (weights, batch) -> (sum of gradients, sum of losses, rows)
BatchGradient = Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, float, int]]


def summed_gradient(rows: DataFrame, w: np.ndarray, batch: BatchGradient) -> tuple[np.ndarray, float, int]:
    def run(batches):
        g, loss, n = np.zeros_like(w), 0.0, 0
        for df in batches:
            if len(df):
                a, b, c = batch(w, df)
                g, loss, n = g + a, loss + b, n + c
        yield pd.DataFrame({"g": [g.tolist()], "loss": [loss], "n": [n]})

    got = rows.mapInPandas(run, "g array<double>, loss double, n long")
    size = len(w)
    if size <= 256:  # short vectors add up in the cluster
        row = got.agg(F.array(*(F.sum(F.col("g")[k]) for k in range(size))).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        return np.array([x or 0.0 for x in row.g]), row.loss or 0.0, row.n or 0
    total, loss, n = np.zeros(size), 0.0, 0
    for row in got.toLocalIterator():  # one partial sum at a time
        total, loss, n = total + np.array(row.g), loss + row.loss, n + row.n
    return total, loss, n


@dataclass
class Momentum:
    rate: float = 0.1
    mu: float = 0.9
    l2: float = 0.0
    state: np.ndarray | None = None

    def __call__(self, w: np.ndarray, g: np.ndarray, i: int) -> np.ndarray:
        g = g + self.l2 * w + (0 if self.state is None else self.mu * self.state)
        self.state = g
        return w - self.rate * g


@dataclass
class AdaGrad:
    """rho 0 adds squares without decay."""

    rate: float = 0.1
    rho: float = 0.0
    epsilon: float = 1e-6
    gamma: float = 1.0
    l2: float = 0.0
    state: np.ndarray | None = None

    def __call__(self, w, g, i):
        g = g + self.l2 * w
        old = 0 if self.state is None else self.state * (self.rho or 1.0)
        self.state = old + g * g
        return w - self.rate * g * self.gamma / (self.epsilon + np.sqrt(self.state))


@dataclass
class AdaDelta:
    rate: float = 1.0
    rho: float = 0.95
    epsilon: float = 1e-6
    l2: float = 0.0
    state: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, w, g, i):
        g = g + self.l2 * w
        eg, ed = self.state or (np.zeros_like(g), np.zeros_like(g))
        eg = self.rho * eg + (1 - self.rho) * g * g
        d = g * np.sqrt(self.epsilon + ed) / np.sqrt(self.epsilon + eg)
        self.state = eg, self.rho * ed + (1 - self.rho) * d * d
        return w - self.rate * d


@dataclass
class Equilibrated:
    """Squares of the gradient times normal draws, averaged over steps."""

    rate: float = 0.1
    epsilon: float = 1e-6
    gamma: float = 1e-2
    l2: float = 0.0
    seed: int = 5
    state: np.ndarray | None = None

    def __call__(self, w, g, i):
        g = g + self.l2 * w
        probe = (g * np.random.default_rng([self.seed, i]).normal(size=g.shape)) ** 2
        self.state = probe if self.state is None else self.state + probe
        return w - self.rate * self.gamma * g / (self.epsilon + np.sqrt(self.state / i))


@dataclass
class Simple:
    rate: float = 0.1
    l2: float = 0.0
    state: None = None

    def __call__(self, w, g, i):
        return w - self.rate / np.sqrt(i) * (g + self.l2 * w)


UPDATERS = {"simple": Simple, "momentum": Momentum, "adagrad": AdaGrad, "adadelta": AdaDelta, "equilibrated": Equilibrated}


@dataclass
class Result:
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)


def minibatch_sgd(rows: DataFrame, w: np.ndarray, batch: BatchGradient, updater, iterations: int, fraction: float = 1.0) -> Result:
    """Mean gradients over seeded Bernoulli samples (seed 42 + iteration); empty samples are skipped."""
    out = Result(w)
    for i in range(1, iterations + 1):
        part = rows if fraction >= 1 else rows.sample(False, fraction, 42 + i)
        g, loss, n = summed_gradient(part, out.weights, batch)
        if n:
            out.losses.append(loss / n)
            out.weights = updater(out.weights, g / n, i)
    return out


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, corrections: int = 10, tolerance: float = 1e-4, iterations: int = 100) -> Result:
    """Limited-memory BFGS with backtracking; f gives the loss and its gradient."""
    loss, g = f(w)
    out = Result(w, [loss])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        if g @ q <= 0:
            q = g
        t = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        while True:
            new = out.weights - t * q
            new_loss, new_g = f(new)
            if new_loss <= loss - 1e-4 * t * (g @ q) or t < 1e-10:
                break
            t /= 2
        if t < 1e-10:
            break
        s, y = new - out.weights, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-corrections:]
        done = abs(loss - new_loss) <= tolerance * max(abs(loss), abs(new_loss), 1e-12)
        out.weights, loss, g = new, new_loss, new_g
        out.losses.append(loss)
        if done:
            break
    return out
