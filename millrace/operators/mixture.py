"""Gaussian mixtures by EM and k-means. A round is one pass: partitions sum up moments, Spark adds them together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.storage import written


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    history: list[float]
    n: int

    @property
    def total_log_likelihood(self) -> float:
        return self.history[-1] * self.n

    def n_params(self, kind: str) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * (d * (d + 1) // 2 if kind == "full" else d)

    def bic(self, kind: str = "full") -> float:
        return self.n_params(kind) * math.log(self.n) - 2 * self.total_log_likelihood

    def aic(self, kind: str = "full") -> float:
        return 2 * self.n_params(kind) - 2 * self.total_log_likelihood


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """log(weight * density) of each row and component."""
    out = np.empty((len(x), len(weights)))
    for k in range(len(weights)):
        root = np.linalg.cholesky(covs[k])
        z = np.linalg.solve(root, (x - means[k]).T)
        out[:, k] = np.log(weights[k]) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + (z * z).sum(axis=0)) - np.log(np.diag(root)).sum()
    return out


def packed(points: DataFrame, columns: list[str]) -> DataFrame:
    """points as a written table of one array x, so that rounds read numbers and nothing else; a packed table stays."""
    return points if points.columns == ["x"] else written(points.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")))


def _moments(d: int, weigh, squares: str) -> object:
    """A partition's sums for each component: of weight, weight * x, and the log-likelihood (k = -1).

    squares adds those of weight * x * x' (full) or of its diagonal (diag).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ll = None, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r, likelihood = weigh(x)
            ll += likelihood
            parts = [r.sum(axis=0)[:, None], r.T @ x]
            if squares == "diag":
                parts.append(r.T @ (x * x))
            elif squares == "full":
                parts.append(np.stack([(x * r[:, [k]]).T @ x for k in range(r.shape[1])]).reshape(r.shape[1], d * d))
            part = np.concatenate(parts, axis=1)
            total = part if total is None else total + part
        if total is not None:
            k, i = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(k.ravel(), -1), pa.int32()), "i": pa.array(np.append(i.ravel(), 0), pa.int32()), "s": np.append(total.ravel(), ll)})

    return run


def _summed(points: DataFrame, columns: list[str], k: int, weigh, squares: str = "none") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over all points of weight, weight * x, weight * x * x' as matrices, and the log-likelihood."""
    d = len(columns)
    sums = packed(points, columns).mapInArrow(_moments(d, weigh, squares), "k int, i int, s double").groupBy("k", "i").agg(F.sum("s").alias("s"))
    table, ll = np.zeros((k, 1 + d + {"none": 0, "diag": d, "full": d * d}[squares])), 0.0
    for r in sums.collect():  # a row a cell of the table, and one more
        if r.k < 0:
            ll = r.s
        else:
            table[r.k, r.i] = r.s
    n, s, rest = table[:, 0], table[:, 1 : 1 + d], table[:, 1 + d :]
    return n, s, rest.reshape(k, d, d) if squares == "full" else np.array([np.diag(v) for v in rest]) if squares == "diag" else rest, ll


def _starts(points: DataFrame, columns: list[str], k: int) -> np.ndarray:
    """k points far from each other: each is the farthest from those before; the first is nearest the mean."""
    n, s, _, _ = _summed(points, columns, 1, lambda x: (np.ones((len(x), 1)), 0.0))
    chosen = [s[0] / max(n[0], 1)]
    for j in range(k):
        near = F.least(*[dot_apart(F.col("x"), p) for p in chosen], F.lit(1e300))
        row = points.select("x", near.alias("_d")).orderBy(F.col("_d").asc() if j == 0 else F.col("_d").desc(), "x").head()
        if j == 0:
            chosen = []
        chosen.append(np.array(row.x, float))
    return np.array(chosen)


def dot_apart(x: Column, p: np.ndarray) -> Column:
    """The squared distance of an array column from a point."""
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in p]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)


def k_means(points: DataFrame, columns: list[str], k: int, rounds: int = 20, tolerance: float = 1e-9, starts: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Centres and the history of the sum of squared distances. Points have no nulls. starts: k centres to begin with."""
    points = packed(points, columns)
    centres, history = _starts(points, columns, k) if starts is None else starts, []
    for _ in range(rounds):
        now = centres

        def nearest(x: np.ndarray, now=now) -> tuple[np.ndarray, float]:
            d = ((x[:, None, :] - now[None]) ** 2).sum(axis=2)
            return np.eye(len(now))[d.argmin(axis=1)], d.min(axis=1).sum()

        n, s, _, cost = _summed(points, columns, k, nearest)
        centres = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
        history.append(float(cost))
        if len(history) > 1 and history[-2] - cost <= tolerance * max(1.0, cost):
            break
    return centres, history


def em_round(points: DataFrame, columns: list[str], model: Mixture, kind: str = "full", ridge: float = 1e-6) -> Mixture:
    """One expectation and one maximisation; history gets the mean log-likelihood of the model that came in."""
    d, now = len(columns), (model.weights, model.means, model.covs)

    def shares(x: np.ndarray) -> tuple[np.ndarray, float]:
        logs = log_densities(x, *now)
        top = logs.max(axis=1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - whole[:, None]), whole.sum()

    r, s, ss, ll = _summed(points, columns, len(model.weights), shares, "full" if kind == "full" else "diag")
    n, r = r.sum(), np.maximum(r, 1e-12)
    means = s / r[:, None]
    covs = ss / r[:, None, None] - np.einsum("ki,kj->kij", means, means)
    covs = covs if kind == "full" else np.array([np.diag(np.maximum(np.diag(c), 0)) for c in covs])
    return Mixture(r / r.sum(), means, covs + ridge * np.eye(d), [*model.history, float(ll / n)], round(n))


def fit_mixture(points: DataFrame, columns: list[str], k: int, kind: str = "full", rounds: int = 50, tolerance: float = 1e-5, ridge: float = 1e-6) -> Mixture:
    """EM from k-means centres. history: mean log-likelihood of each round. Components are ordered by their means."""
    points = packed(points, columns)
    means, _ = k_means(points, columns, k)
    d = len(columns)
    n, s, ss, _ = _summed(points, columns, 1, lambda x: (np.ones((len(x), 1)), 0.0), "diag")
    spread = np.diag(ss[0]) / n[0] - (s[0] / n[0]) ** 2
    model = Mixture(np.full(k, 1 / k), means, np.array([np.diag(spread) + ridge * np.eye(d)] * k), [], int(n[0]))
    for _ in range(rounds):
        model = em_round(points, columns, model, kind, ridge)
        if len(model.history) > 1 and abs(model.history[-1] - model.history[-2]) < tolerance:
            break
    weights, means, covs, history = model.weights, model.means, model.covs, model.history
    order = np.lexsort(means.T[::-1])
    return Mixture(weights[order], means[order], covs[order], history, model.n)


def select_mixture(points: DataFrame, columns: list[str], ks: list[int], kind: str = "full") -> Mixture:
    """The mixture with the smallest BIC."""
    points = packed(points, columns)
    return min((fit_mixture(points, columns, k, kind) for k in ks), key=lambda m: m.bic(kind))


def component_logs(points: DataFrame, columns: list[str], model: Mixture, keep: list[str]) -> DataFrame:
    """keep and logs: log(weight * density) of each component."""
    types = dict(points.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[keep].assign(logs=list(log_densities(b[columns].to_numpy(float), model.weights, model.means, model.covs)))

    return points.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", logs array<double>")


def assign(points: DataFrame, columns: list[str], model: Mixture, keep: list[str]) -> DataFrame:
    """keep and component: the likeliest one."""
    types = dict(points.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                logs = log_densities(b[columns].to_numpy(float), model.weights, model.means, model.covs)
                yield b[keep].assign(component=logs.argmax(axis=1).astype("int32"))

    return points.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", component int")
