"""Feed-forward networks, restricted Boltzmann machines, stacks and belief networks.

Weights are NumPy arrays on the driver (their size is the model's, not the
data's); tasks compute partial gradients over Arrow batches of rows
(features array<double>, target array<double>).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .optim import Result, lbfgs, minibatch_sgd, summed_gradient

# ------------------------------------------------------------ activations


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: name -> (activation, derivative from the output)
ACTIVATIONS = {
    "sigmoid": (_sigmoid, lambda y: y * (1 - y)),
    "tanh": (np.tanh, lambda y: 1 - y * y),
    "softmax": (_softmax, lambda y: y * (1 - y)),
    "relu": (lambda x: np.maximum(x, 0), lambda y: (y > 0).astype(float)),
    "noisyrelu": (lambda x: np.maximum(x, 0), lambda y: (y > 0).astype(float)),
    "softplus": (lambda x: np.logaddexp(0, x), lambda y: 1 - np.exp(-y)),
    "identity": (lambda x: x, lambda y: np.ones_like(y)),
}


def sample_layer(kind: str, mean: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A stochastic state of a layer from its mean."""
    if kind in ("sigmoid", "softmax"):
        return (rng.random(mean.shape) < mean).astype(float)
    if kind in ("relu", "noisyrelu"):
        return np.maximum(0, mean + rng.normal(size=mean.shape) * np.sqrt(_sigmoid(mean)))
    if kind == "identity":
        return mean + rng.normal(size=mean.shape)
    return mean


@dataclass
class Layer:
    weight: np.ndarray  # out x in
    bias: np.ndarray
    kind: str = "sigmoid"

    @staticmethod
    def create(n_in: int, n_out: int, kind: str, rng: np.random.Generator) -> Layer:
        if kind not in ACTIVATIONS:
            raise ValueError(f"no such layer: {kind}")
        s = np.sqrt(6 / (n_in + n_out)) * (4 if kind == "sigmoid" else 1)
        return Layer(rng.uniform(-s, s, (n_out, n_in)), np.zeros(n_out), kind)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return ACTIVATIONS[self.kind][0](x @ self.weight.T + self.bias)


# ------------------------------------------------------------ feed-forward


class Network:
    """Layers in order; ``dropout[k]`` is the share of layer k's outputs that training drops."""

    def __init__(self, layers: list[Layer], dropout: list[float] | None = None):
        self.layers, self.dropout = layers, dropout or [0.0] * len(layers)

    @staticmethod
    def create(sizes: list[int], kinds: list[str] | None = None, seed: int = 3, dropout: list[float] | None = None) -> Network:
        """Hidden layers are ReLU and the head softmax unless ``kinds`` says otherwise."""
        rng = np.random.default_rng(seed)
        kinds = kinds or ["relu"] * (len(sizes) - 2) + ["softmax"]
        return Network([Layer.create(a, b, k, rng) for a, b, k in zip(sizes[:-1], sizes[1:], kinds, strict=True)], dropout)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([l.weight.ravel("F"), l.bias]) for l in self.layers])

    def with_flat(self, w: np.ndarray) -> Network:
        out, at = [], 0
        for l in self.layers:
            n = l.weight.size
            out.append(Layer(w[at : at + n].reshape(l.weight.shape, order="F"), w[at + n : at + n + len(l.bias)], l.kind))
            at += n + len(l.bias)
        return Network(out, self.dropout)

    def outputs(self, x: np.ndarray, rng: np.random.Generator | None = None) -> list[np.ndarray]:
        """Each layer's output; with ``rng`` some are dropped and the rest scaled up."""
        out = []
        for l, p in zip(self.layers, self.dropout, strict=True):
            x = l.forward(x)
            if rng is not None and p > 0:
                x = x * (rng.random(x.shape) >= p) / (1 - p)
            out.append(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.outputs(x)[-1]

    def loss(self, y: np.ndarray, t: np.ndarray) -> float:
        """Cross-entropy of a softmax head, else half the squared error; summed over rows."""
        if self.layers[-1].kind == "softmax":
            return float(-(t * np.log(np.maximum(y, 1e-300))).sum())
        return float(0.5 * ((y - t) ** 2).sum())

    def gradient(self, x: np.ndarray, t: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, float]:
        """Sum of gradients over rows, flat, and the summed loss."""
        ys = self.outputs(x, rng)
        delta = ys[-1] - t
        if self.layers[-1].kind != "softmax":
            delta = delta * ACTIVATIONS[self.layers[-1].kind][1](ys[-1])
        parts = []
        for k in range(len(self.layers) - 1, -1, -1):
            below = ys[k - 1] if k else x
            parts.append(np.concatenate([(delta.T @ below).ravel("F"), delta.sum(0)]))
            if k:
                delta = (delta @ self.layers[k].weight) * ACTIVATIONS[self.layers[k - 1].kind][1](below)
                if rng is not None and self.dropout[k - 1] > 0:
                    delta = delta * (below != 0) / (1 - self.dropout[k - 1])
        return np.concatenate(parts[::-1]), self.loss(ys[-1], t)

    def adversarial(self, x: np.ndarray, t: np.ndarray, epsilon: float) -> np.ndarray:
        """Rows moved by epsilon along the sign of the loss's gradient in the input."""
        ys = self.outputs(x)
        delta = ys[-1] - t
        if self.layers[-1].kind != "softmax":
            delta = delta * ACTIVATIONS[self.layers[-1].kind][1](ys[-1])
        for k in range(len(self.layers) - 1, 0, -1):
            delta = (delta @ self.layers[k].weight) * ACTIVATIONS[self.layers[k - 1].kind][1](ys[k - 1])
        return x + epsilon * np.sign(delta @ self.layers[0].weight)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def batch_rng(seed: int, w: np.ndarray, x: np.ndarray) -> np.random.Generator:
    """Other draws for each step and batch, and the same ones if a task is run again."""
    return np.random.default_rng([seed, zlib.crc32(np.ascontiguousarray(w).tobytes()), zlib.crc32(np.ascontiguousarray(x).tobytes())])


def train_network(rows: DataFrame, net: Network, updater, iterations: int, fraction: float = 1.0, seed: int = 9) -> tuple[Network, list[float]]:
    """Mini-batch gradient steps."""
    drops = any(net.dropout)

    def batch(w, df):
        x = _matrix(df["features"])
        rng = batch_rng(seed, w, x) if drops else None
        g, loss = net.with_flat(w).gradient(x, _matrix(df["target"]), rng)
        return g, loss, len(df)

    r = minibatch_sgd(rows, net.flat(), batch, updater, iterations, fraction)
    return net.with_flat(r.weights), r.losses


def train_network_lbfgs(rows: DataFrame, net: Network, iterations: int = 20, l2: float = 0.0) -> tuple[Network, list[float]]:
    """Full-batch L-BFGS; each evaluation is one pass."""

    def batch(w, df):
        g, loss = net.with_flat(w).gradient(_matrix(df["features"]), _matrix(df["target"]))
        return g, loss, len(df)

    def f(w):
        g, loss, n = summed_gradient(rows, w, batch)
        return loss / max(n, 1) + 0.5 * l2 * float(w @ w), g / max(n, 1) + l2 * w

    r: Result = lbfgs(f, net.flat(), iterations=iterations)
    return net.with_flat(r.weights), r.losses


def predict(rows: DataFrame, net: Network) -> DataFrame:
    """Rows with their output array."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(net.predict(_matrix(x)))) if len(x) else x

    return rows.withColumn("output", F.pandas_udf(run, "array<double>")("features"))


def error_rate(predicted: DataFrame) -> DataFrame:
    """Share of rows whose largest output isn't the target's largest."""
    top = lambda c: F.array_position(c, F.array_max(c))
    return predicted.agg(F.avg((top(F.col("output")) != top(F.col("target"))).cast("double")).alias("error"))


# ------------------------------------------------------------ Boltzmann machines


@dataclass
class RBM:
    weight: np.ndarray  # hidden x visible
    visible: np.ndarray
    hidden: np.ndarray
    visible_kind: str = "sigmoid"
    hidden_kind: str = "sigmoid"

    @staticmethod
    def create(n_visible: int, n_hidden: int, visible: str = "sigmoid", hidden: str = "sigmoid", seed: int = 4) -> RBM:
        rng = np.random.default_rng(seed)
        return RBM(rng.normal(0, 0.01, (n_hidden, n_visible)), np.zeros(n_visible), np.zeros(n_hidden), visible, hidden)

    def up(self, v):
        return ACTIVATIONS[self.hidden_kind][0](v @ self.weight.T + self.hidden)

    def down(self, h):
        return ACTIVATIONS[self.visible_kind][0](h @ self.weight + self.visible)

    def flat(self):
        return np.concatenate([self.weight.ravel("F"), self.visible, self.hidden])

    def with_flat(self, w):
        n, v = self.weight.size, len(self.visible)
        return RBM(w[:n].reshape(self.weight.shape, order="F"), w[n : n + v], w[n + v :], self.visible_kind, self.hidden_kind)

    def gradient(self, v0: np.ndarray, rng: np.random.Generator, k: int = 1, dropout: float = 0.0) -> tuple[np.ndarray, float]:
        """Contrastive divergence: h_k v_k^T - h_0 v_0^T summed over rows, and the squared reconstruction error."""
        mask = (rng.random((len(v0), len(self.hidden))) >= dropout) / (1 - dropout) if dropout else 1.0
        h0 = self.up(v0) * mask
        vk, hk = v0, h0
        for _ in range(k):
            vk = self.down(sample_layer(self.hidden_kind, hk, rng) * (mask if dropout else 1.0))
            hk = self.up(vk) * mask
        g = np.concatenate([(hk.T @ vk - h0.T @ v0).ravel("F"), (vk - v0).sum(0), (hk - h0).sum(0)])
        return g, float(((vk - v0) ** 2).sum())


def train_rbm(rows: DataFrame, rbm: RBM, updater, iterations: int, k: int = 1, fraction: float = 1.0, dropout: float = 0.0, seed: int = 8, column: str = "features") -> tuple[RBM, list[float]]:
    def batch(w, df):
        v = _matrix(df[column])
        rng = batch_rng(seed, w, v)
        g, err = rbm.with_flat(w).gradient(v, rng, k, dropout)
        return g, err, len(df)

    r = minibatch_sgd(rows, rbm.flat(), batch, updater, iterations, fraction)
    return rbm.with_flat(r.weights), r.losses


def train_stack(rows: DataFrame, sizes: list[int], updater_factory, iterations: int, kind: str = "sigmoid") -> list[RBM]:
    """Greedy layers: each machine learns the means of the one below."""
    out: list[RBM] = []
    for n_in, n_out in zip(sizes[:-1], sizes[1:], strict=True):
        below = list(out)

        def lift(x: pd.Series, below=below) -> pd.Series:
            v = _matrix(x)
            for m in below:
                v = m.up(v)
            return pd.Series(list(v))

        data = rows.withColumn("_v", F.pandas_udf(_typed(lift), "array<double>")("features")) if below else rows.withColumn("_v", F.col("features"))
        m, _ = train_rbm(data.select("_v"), RBM.create(n_in, n_out, kind, kind), updater_factory(), iterations, column="_v")
        out.append(m)
    return out


def _typed(f):
    def run(x: pd.Series) -> pd.Series:
        return f(x)

    return run


def stack_to_network(stack: list[RBM], classes: int, seed: int = 6) -> Network:
    """The stack's layers with a softmax head: a belief network ready for fine-tuning."""
    layers = [Layer(m.weight.copy(), m.hidden.copy(), m.hidden_kind) for m in stack]
    head = Layer.create(len(stack[-1].hidden), classes, "softmax", np.random.default_rng(seed))
    return Network([*layers, head])


def train_belief_network(rows: DataFrame, sizes: list[int], classes: int, updater_factory, pretrain: int, finetune: int) -> tuple[Network, list[float]]:
    net = stack_to_network(train_stack(rows, sizes, updater_factory, pretrain), classes)
    return train_network(rows, net, updater_factory(), finetune)
