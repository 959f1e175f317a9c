"""Surrogates that are trained: a neural network by sums of gradients, Gaussian processes and radial bases by sums of products.

No row of a training table leaves the executors. A pass over it is one aggregation: tasks add up a vector of fixed length
(a gradient, or normal equations), Spark adds these up by place, and the driver makes one step with the result. What the
driver holds and broadcasts is bounded by the model, not by the table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.registry import lookup, register
from sweeplane.functions.tables import cut
from sweeplane.operators.surrogate import SURROGATES, KernelSurrogate

#: Weights a network may have, and points a kernel model may have: they bound what a pass sums.
MOST_WEIGHTS = 1 << 20
MOST_CENTRES = 1024

Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def summed(rows: DataFrame, kernel: Sums, length: int, x: str = "x", y: str = "y", part: str = "part") -> np.ndarray:
    """The sum over all rows of ``kernel(x, y, part)``, a vector of ``length`` for a batch; x and y are arrays of fixed length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for pdf in batches:
            if len(pdf):
                total += kernel(np.array(pdf[x].tolist(), dtype=float), np.array(pdf[y].tolist(), dtype=float), pdf[part].to_numpy())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total[at]})

    out = np.zeros(length)
    for r in rows.select(x, y, part).mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


# -- neural networks ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Network:
    """Layers of tanh and a linear last one; ``weights`` is all matrices and biases, one behind the other."""

    layers: tuple[int, ...]
    weights: np.ndarray = field(repr=False)

    @classmethod
    def start(cls, layers: tuple[int, ...], seed: int = 0, zero: bool = False) -> Network:
        """Uniform weights of a layer's usual scale, zero biases."""
        draw, parts = np.random.default_rng(seed), []
        for a, b in zip(layers, layers[1:], strict=False):
            reach = 0.0 if zero else math.sqrt(6 / (a + b))
            parts += [draw.uniform(-reach, reach, a * b), np.zeros(b)]
        weights = np.concatenate(parts)
        if len(weights) > MOST_WEIGHTS:
            raise ValueError(f"a network has {MOST_WEIGHTS} weights at most")
        return cls(tuple(layers), weights)

    def parts(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.layers, self.layers[1:], strict=False):
            out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and the output of every layer."""
        seen, layers = [x], self.parts(self.weights)
        for n, (w, b) in enumerate(layers):
            z = seen[-1] @ w + b
            seen.append(z if n == len(layers) - 1 else np.tanh(z))
        return seen

    def loss_sums(self, x: np.ndarray, y: np.ndarray, gradient: bool) -> tuple[float, np.ndarray | None]:
        """The sum of squared errors, and its gradient."""
        seen = self.forward(x)
        error = seen[-1] - y
        loss = float((error * error).sum())
        if not gradient:
            return loss, None
        back, parts = 2 * error, []
        for (w, _), before in zip(reversed(self.parts(self.weights)), reversed(seen[:-1]), strict=True):
            parts.append(np.concatenate([(before.T @ back).ravel(), back.sum(axis=0)]))
            back = (back @ w.T) * (1 - before * before)
        return loss, np.concatenate(parts[::-1])


def epoch_sums(net: Network) -> Sums:
    """Gradient, squared error and values of the rows of part ``train``; squared error and values of those of ``val``."""

    def kernel(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
        train, val = part == "train", part == "val"
        loss, gradient = net.loss_sums(x[train], y[train], True)
        other, _ = net.loss_sums(x[val], y[val], False)
        return np.concatenate([gradient, [loss, y[train].size, other, y[val].size]])

    return kernel


OPTIMIZERS: dict[str, type] = {}
SCHEDULES: dict[str, Callable[[int, int], float]] = {
    "constant": lambda epoch, epochs: 1.0,
    "cosine": lambda epoch, epochs: 0.5 * (1 + math.cos(math.pi * epoch / max(1, epochs))),
    "step": lambda epoch, epochs: 0.5 ** (4 * epoch // max(1, epochs)),
}


@register(OPTIMIZERS, "sgd")
@dataclass
class Sgd:
    """Steps along the gradient, with momentum."""

    momentum: float = 0.0
    moved: np.ndarray | float = 0.0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.moved = self.momentum * self.moved + gradient
        return -rate * self.moved


@register(OPTIMIZERS, "adam")
@dataclass
class Adam:
    """Steps by running means of the gradient and of its square."""

    keep: float = 0.9
    keep_square: float = 0.999
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0
    turn: int = 0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.turn += 1
        self.mean = self.keep * self.mean + (1 - self.keep) * gradient
        self.square = self.keep_square * self.square + (1 - self.keep_square) * gradient**2
        mean, square = self.mean / (1 - self.keep**self.turn), self.square / (1 - self.keep_square**self.turn)
        return -rate * mean / (np.sqrt(square) + 1e-8)


@dataclass(frozen=True)
class Fit:
    """The network of the best epoch, and the mean squared errors of each: (train, val; NaN without rows)."""

    network: Network
    history: list[tuple[float, float]]
    best: int


def fit_network(
    rows: DataFrame, net: Network, epochs: int = 200, rate: float = 0.01, optimizer: str = "adam", schedule: str = "constant",
    patience: int | None = 20, decay: float = 0.0,
) -> Fit:
    """Train on rows (x, y, part): gradients of part ``train``, early stopping on ``val``, or on ``train`` without any of it.

    Each epoch is one pass in full batch: both errors are those of the weights at its beginning. It stops ``patience`` epochs
    behind the best one, whose weights are returned. ``decay`` is weight decay. Rows of other parts, and null or non-finite
    ones, take no part; without a row of ``train`` it raises. The result does not depend on partitioning but for rounding.
    """
    good = F.forall("x", _finite) & F.forall("y", _finite) & (F.size("x") == net.layers[0]) & (F.size("y") == net.layers[-1])
    rows = cut(rows.where(good & F.col("part").isin("train", "val")).select("x", "y", "part"))
    stepper, plan = lookup(OPTIMIZERS, optimizer)(), SCHEDULES[schedule]
    history, best = [], (math.inf, 0, net)
    for epoch in range(epochs + 1):
        total = summed(rows, epoch_sums(net), len(net.weights) + 4)
        gradient, (loss, values, other, others) = total[:-4], total[-4:]
        if not values:
            raise ValueError("no row to train on")
        history.append((loss / values, other / others if others else math.nan))
        now = history[-1][1] if others else history[-1][0]
        if now < best[0]:
            best = (now, epoch, net)
        if epoch == epochs or not math.isfinite(now) or (patience is not None and epoch - best[1] >= patience):
            break
        step = stepper.step(gradient / values + decay * net.weights, rate * plan(epoch, epochs))
        net = replace(net, weights=net.weights + step)
    return Fit(best[2], history, best[1])


def _finite(v):
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def spread(rows: DataFrame, columns: tuple[str, ...] = ("x", "y"), part: str = "part", floor: float = 1e-12) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each place of array columns over the rows of part ``train``: one aggregation, a row a place."""
    out = {}
    for c in columns:
        at = rows.where(F.col(part) == "train").select(F.posexplode(c).alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        got = sorted(at.collect(), key=lambda r: r["at"])
        out[c] = np.array([r["m"] for r in got]), np.maximum([r["s"] for r in got], floor)
    return out


@register(SURROGATES, "nn")
@dataclass(frozen=True)
class NeuralSurrogate:
    """A network from design variables to the elements of a sweep, both scaled by the training rows' mean and deviation.

    A response is y: real parts of all frequencies and port pairs, row-major, then the imaginary ones.
    """

    variables: tuple[str, ...]
    freq_hz: tuple[float, ...]
    n_ports: int
    network: Network
    x_scale: tuple[tuple[float, ...], tuple[float, ...]]
    y_scale: tuple[tuple[float, ...], tuple[float, ...]]

    @classmethod
    def fit(cls, samples: DataFrame, variables: tuple[str, ...], freq_hz: tuple[float, ...], n_ports: int = 1, hidden: tuple[int, ...] = (16,), seed: int = 0, **options) -> tuple[NeuralSurrogate, Fit]:
        """Fit on ``samples``: a column for each variable, y, and part (train or val). Statistics are those of train alone."""
        rows = samples.select(F.array(*(F.col(v).cast("double") for v in variables)).alias("x"), "y", "part")
        scales = spread(rows)
        arrays = {c: [F.array(*(F.lit(float(v)) for v in part)) for part in scales[c]] for c in scales}
        scaled = {c: F.zip_with(F.zip_with(c, m, lambda a, b: a - b), s, lambda a, b: a / b) for c, (m, s) in arrays.items()}
        start = Network.start((len(variables), *hidden, 2 * len(freq_hz) * n_ports * n_ports), seed)
        found = fit_network(rows.select(scaled["x"].alias("x"), scaled["y"].alias("y"), "part"), start, **options)
        plain = {c: tuple(tuple(map(float, part)) for part in scales[c]) for c in scales}
        return cls(tuple(variables), tuple(freq_hz), n_ports, found.network, plain["x"], plain["y"]), found

    def forward(self, x: np.ndarray) -> np.ndarray:
        """(n, variables) to complex (n, frequencies, ports, ports)."""
        scaled = (x - np.array(self.x_scale[0])) / np.array(self.x_scale[1])
        y = self.network.forward(scaled)[-1] * np.array(self.y_scale[1]) + np.array(self.y_scale[0])
        re, im = np.split(y, 2, axis=1)
        return (re + 1j * im).reshape(len(x), len(self.freq_hz), self.n_ports, self.n_ports)

    def transform(self, points: DataFrame) -> DataFrame:
        return KernelSurrogate(self.variables, self.freq_hz, self.forward).transform(points)

    def dumps(self) -> str:
        """Codec, scalers and weights as one text."""
        return json.dumps({
            "variables": self.variables, "freq_hz": self.freq_hz, "n_ports": self.n_ports, "layers": self.network.layers, "weights": self.network.weights.tolist(),
            "x_scale": self.x_scale, "y_scale": self.y_scale,
        })

    @classmethod
    def loads(cls, text: str) -> NeuralSurrogate:
        d = json.loads(text)
        pair = lambda s: tuple(tuple(part) for part in s)
        net = Network(tuple(d["layers"]), np.array(d["weights"]))
        return cls(tuple(d["variables"]), tuple(d["freq_hz"]), d["n_ports"], net, pair(d["x_scale"]), pair(d["y_scale"]))


# -- kernels ------------------------------------------------------------------------------------------------------


def gauss(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """exp(-|a - b|^2 / 2 length^2) of all rows with all rows."""
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-np.maximum(d2, 0) / (2 * length * length))


def choose_centres(rows: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """``n`` distinct x of part ``train``, picked by a hash of x; all of them, if fewer."""
    if not 0 < n <= MOST_CENTRES:
        raise ValueError(f"from 1 to {MOST_CENTRES} centres")
    picked = rows.where(F.col("part") == "train").select("x").distinct().orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(n).collect()
    return np.array([r["x"] for r in picked], dtype=float)


def _kernel_sums(centres: np.ndarray, length: float, outputs: int) -> Sums:
    """Sums of k k' and k y' over the rows of part ``train``, k the kernel of a row with each centre."""

    def kernel(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
        k = gauss(x[part == "train"], centres, length)
        return np.concatenate([(k.T @ k).ravel(), (k.T @ y[part == "train"]).ravel()])

    return kernel


@register(SURROGATES, "gp")
@dataclass(frozen=True)
class GaussianProcess:
    """A Gaussian process of unit prior variance seen through inducing points, with a predictive variance.

    With all training points as inducing points it is the full process. Memory is the square of the inducing points' number.
    """

    centres: np.ndarray
    length: float
    noise: float
    mean_weights: np.ndarray
    cover: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, centres: np.ndarray, length: float = 1.0, noise: float = 0.1, jitter: float = 1e-10) -> GaussianProcess:
        """``rows`` are (x, y, part); ``noise`` is the deviation of an observation. One pass, then two Cholesky factors."""
        m = len(centres)
        outputs = len(rows.select("y").first()["y"])
        total = summed(rows, _kernel_sums(centres, length, outputs), m * m + m * outputs)
        products, right = total[: m * m].reshape(m, m), total[m * m :].reshape(m, outputs)
        prior = gauss(centres, centres, length) + jitter * np.eye(m)
        low = np.linalg.cholesky(prior)
        # In the basis that whitens the prior, the posterior's precision is I + L^-1 (sum k k') L'^-1 / noise^2.
        half = np.linalg.solve(low, np.linalg.solve(low, products).T).T
        post = np.linalg.cholesky(np.eye(m) + (half + half.T) / 2 / noise**2)
        whitened = np.linalg.solve(post, np.linalg.solve(low, right)) / noise**2
        mean = np.linalg.solve(low.T, np.linalg.solve(post.T, whitened))
        inverse = np.linalg.solve(low.T, np.eye(m))
        seen = np.linalg.solve(post, inverse.T)
        return cls(centres, length, noise, mean, inverse @ inverse.T - seen.T @ seen)

    def predict(self, points: DataFrame, x: str = "x") -> DataFrame:
        """``points`` with mean array<double> and variance (of the response, without an observation's noise)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                k = gauss(np.array(pdf[x].tolist(), dtype=float).reshape(len(pdf), -1), self.centres, self.length)
                yield pdf.assign(mean=list(k @ self.mean_weights), variance=np.maximum(1 - ((k @ self.cover) * k).sum(axis=1), 0))

        return points.mapInPandas(run, f"{points.schema.toDDL()}, mean array<double>, variance double")


@register(SURROGATES, "rbf")
@dataclass(frozen=True)
class RadialBasis:
    """Least squares of radial bases at given centres, with a ridge."""

    centres: np.ndarray
    length: float
    weights: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, centres: np.ndarray, length: float = 1.0, ridge: float = 1e-9) -> RadialBasis:
        m, outputs = len(centres), len(rows.select("y").first()["y"])
        total = summed(rows, _kernel_sums(centres, length, outputs), m * m + m * outputs)
        return cls(centres, length, np.linalg.solve(total[: m * m].reshape(m, m) + ridge * np.eye(m), total[m * m :].reshape(m, outputs)))

    def predict(self, points: DataFrame, x: str = "x") -> DataFrame:
        """``points`` with mean array<double>."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(mean=list(gauss(np.array(pdf[x].tolist(), dtype=float).reshape(len(pdf), -1), self.centres, self.length) @ self.weights))

        return points.mapInPandas(run, f"{points.schema.toDDL()}, mean array<double>")
