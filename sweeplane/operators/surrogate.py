"""Surrogates: design points to networks, vectorised over Arrow batches or as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplane.functions.registry import lookup, register
from sweeplane.operators.network import to_points

SURROGATES: dict[str, type] = {}


def get_surrogate(name: str) -> type:
    return lookup(SURROGATES, name)


class Surrogate(Protocol):
    def transform(self, points: DataFrame) -> DataFrame:
        """point_id and variables in; points of networks (sample_id = point_id) out."""


@register(SURROGATES, "linear")
@dataclass(frozen=True)
class LinearSurrogate:
    """Each element of the matrix is an affine function of the variables, at each frequency.

    ``coefficients`` are (k, f_hz, i, j, {variable: (re, im)}, (re, im)) rows, a small table.
    """

    variables: tuple[str, ...]
    coefficients: tuple[tuple, ...]

    def transform(self, points: DataFrame) -> DataFrame:
        rows = [
            {"k": k, "f_hz": f, "i": i, "j": j, "wr": [w[v][0] for v in self.variables] + [c[0]], "wi": [w[v][1] for v in self.variables] + [c[1]]}
            for k, f, i, j, w, c in self.coefficients
        ]
        # The coefficients are one constant of the plan: each point is unfolded by it within its row.
        kind = "array<struct<k:long,f_hz:double,i:long,j:long,wr:array<double>,wi:array<double>>>"
        x = F.array(*(F.col(v).cast("double") for v in self.variables), F.lit(1.0))
        dot = lambda w: F.aggregate(F.zip_with(x, F.col(w), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        met = points.withColumn("e", F.explode(F.from_json(F.lit(json.dumps(rows)), kind)))
        return met.select(F.col("point_id").alias("sample_id"), "e.k", "e.f_hz", "e.i", "e.j", dot("e.wr").alias("re"), dot("e.wi").alias("im"))

    def dumps(self) -> str:
        return json.dumps({"variables": self.variables, "coefficients": self.coefficients})

    @classmethod
    def loads(cls, text: str) -> LinearSurrogate:
        d = json.loads(text)
        rows = tuple((k, f, i, j, {v: tuple(x) for v, x in w.items()}, tuple(c)) for k, f, i, j, w, c in d["coefficients"])
        return cls(tuple(d["variables"]), rows)


@register(SURROGATES, "kernel")
@dataclass(frozen=True)
class KernelSurrogate:
    """Any vectorised forward function: an (n, d) array to complex (n, F, P, P), applied to Arrow batches."""

    variables: tuple[str, ...]
    freq_hz: tuple[float, ...]
    forward: Callable[[np.ndarray], np.ndarray]

    def transform(self, points: DataFrame) -> DataFrame:
        names, grid, forward = list(self.variables), list(self.freq_hz), self.forward

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                s = np.asarray(forward(pdf[names].to_numpy(dtype=float)))
                flat = s.reshape(len(pdf), -1)
                yield pd.DataFrame({
                    "sample_id": pdf["point_id"], "n_ports": np.int32(s.shape[-1]), "f_hz": [grid] * len(pdf),
                    "s_re": list(flat.real.astype(float)), "s_im": list(flat.imag.astype(float)),
                })

        schema = "sample_id long, n_ports int, f_hz array<double>, s_re array<double>, s_im array<double>"
        return to_points(points.select("point_id", *names).mapInPandas(run, schema))


@register(SURROGATES, "inverse_linear")
@dataclass(frozen=True)
class InverseLinear:
    """Least-squares map from encoded responses back to parameters; fitted from sums, so no row leaves the executors."""

    weights: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(cls, rows: DataFrame, y: str = "y", x: str = "x", ridge: float = 1e-9) -> InverseLinear:
        """``y`` and ``x`` are arrays of fixed length. The normal equations are one aggregation of their size."""
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                a = np.column_stack([np.array(pdf[y].tolist(), dtype=float), np.ones(len(pdf))])
                b = np.array(pdf[x].tolist(), dtype=float)
                part = np.hstack([a.T @ a, a.T @ b])
                total = part if total is None else total + part
            if total is not None:
                r, c = np.indices(total.shape)
                yield pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "v": total.ravel()})

        got = rows.select(y, x).mapInPandas(sums, "r long, c long, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).collect()
        m = np.zeros((max(r["r"] for r in got) + 1, max(r["c"] for r in got) + 1))
        for r in got:
            m[r["r"], r["c"]] = r["v"]
        n = len(m)
        w = np.linalg.solve(m[:, :n] + ridge * np.eye(n), m[:, n:])
        return cls(tuple(tuple(row) for row in w.T.tolist()))

    def predict(self, y: Column | str) -> Column:
        one = F.concat(F.col(y) if isinstance(y, str) else y, F.array(F.lit(1.0)))
        dot = lambda w: F.aggregate(F.zip_with(one, F.array(*(F.lit(c) for c in w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.array(*(dot(w) for w in self.weights))
