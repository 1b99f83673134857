"""Gaussian mixtures of many kinds and folds fitted together: a round of all of them is one pass over the points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_bucket
from millrace.sources.storage import written

from .mixture import Mixture, log_densities


@dataclass
class Searched:
    """scores: (options, mean held-out log-likelihood, that of each fold); model: the best options' fit on all points."""

    best: dict
    scores: list[tuple[dict, float, list[float]]]
    model: Mixture


def _logs(x: np.ndarray, m: Mixture, kind: str) -> np.ndarray:
    if kind == "full":
        return log_densities(x, m.weights, m.means, m.covs)
    var = np.stack([np.diag(c) for c in m.covs])
    square = (x * x) @ (1 / var).T - 2 * x @ (m.means / var).T + (m.means**2 / var).sum(axis=1)
    return np.log(m.weights) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + square) - 0.5 * np.log(var).sum(axis=1)


def _whole(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column("fold").to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, sizes: list[int], numbers) -> list[np.ndarray]:
    """For each model, the sums over all rows of the sizes[m] numbers that numbers(x, fold) gives for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in sizes]
        for batch in batches:
            if batch.num_rows:
                for t, part in zip(total, numbers(*_points(batch)), strict=True):
                    t += part
        m = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        cell = np.concatenate([np.arange(s) for s in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(cell), pa.array(np.concatenate(total))], ["m", "cell", "s"])

    found = rows.mapInArrow(run, "m int, cell long, s double").groupBy("m", "cell").agg(F.sum("s").alias("s")).toArrow()  # the models' parameters
    out = [np.zeros(s) for s in sizes]
    m, cell, s = (found[c].to_numpy() for c in ("m", "cell", "s"))
    for k, o in enumerate(out):
        o[cell[m == k]] = s[m == k]
    return out


def _updated(total: np.ndarray, k: int, d: int, kind: str, ridge: float, old: Mixture) -> Mixture:
    r, s, rest = total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d : -2]
    n, ll = total[-2], total[-1]
    r = np.maximum(r, 1e-12)
    means = s / r[:, None]
    if kind == "full":
        covs = rest.reshape(k, d, d) / r[:, None, None] - np.einsum("ki,kj->kij", means, means)
    else:
        covs = np.stack([np.diag(v) for v in np.maximum(rest.reshape(k, d) / r[:, None] - means**2, 0)])
    return Mixture(r / r.sum(), means, covs + ridge * np.eye(d), [*old.history, float(ll / n)], round(n))


def search_mixtures(points: DataFrame, columns: list[str], key: str, grid: list[dict], folds: int = 5, rounds: int = 50, tolerance: float = 1e-5, ridge: float = 1e-6, seed: int = 0) -> Searched:
    """Cross-validated choice among mixtures; grid: k (components) and kind ("full" or "diag") of each.

    Points are dealt to folds by the hash of key. For each entry one model is fitted without each fold and one on all
    points; all of them share the passes, a round of EM each, until the last one's mean log-likelihood moves by less
    than tolerance. Models start at the k training points of the smallest hashes, with the training points' variances.
    The best mean held-out log-likelihood wins, the first of equal ones. Points have no nulls; a table without points,
    or with fewer than folds * 2, is an error.
    """
    d = len(columns)
    order = hash_bucket(F.col(key), seed + 1, 1 << 31)
    rows = written(points.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), hash_bucket(F.col(key), seed, folds).cast("int").alias("fold"), order.alias("h"), F.col(key).alias("key")))
    parts = [*range(folds), -1]  # -1: no fold is left out
    most = max(g["k"] for g in grid)
    firsts = None
    for f in parts:
        some = rows.where(F.col("fold") != f).orderBy("h", "key").limit(most).select(F.lit(f).alias("f"), "h", "key", "x")
        firsts = some if firsts is None else firsts.unionByName(some)
    chosen: dict[int, list] = {f: [] for f in parts}
    for r in sorted(firsts.collect(), key=lambda r: (r.f, r.h, r.key)):  # most points for each fold
        chosen[r.f].append(np.array(r.x))
    if min(map(len, chosen.values())) < most:
        raise ValueError("too few points")

    def first_moments(x: np.ndarray, fold: np.ndarray):
        for f in parts:
            own = x[fold != f]
            yield np.concatenate([[len(own)], own.sum(axis=0), (own * own).sum(axis=0)])

    spread = {f: np.diag(np.maximum(t[1 + d :] / t[0] - (t[1 : 1 + d] / t[0]) ** 2, 0)) + ridge * np.eye(d) for f, t in zip(parts, _summed(rows, [1 + 2 * d] * len(parts), first_moments), strict=True)}
    models = {(c, f): Mixture(np.full(g["k"], 1 / g["k"]), np.stack(chosen[f][: g["k"]]), np.array([spread[f]] * g["k"]), [], 0) for c, g in enumerate(grid) for f in parts}
    alive = list(models)
    for _ in range(rounds):
        kinds = {a: grid[a[0]].get("kind", "full") for a in alive}
        sizes = [grid[c]["k"] * (1 + d + (d * d if kinds[c, f] == "full" else d)) + 2 for c, f in alive]
        now = {a: models[a] for a in alive}

        def moments(x: np.ndarray, fold: np.ndarray, now=now, kinds=kinds):
            for a, m in now.items():
                own = x[fold != a[1]]
                logs = _logs(own, m, kinds[a])
                whole = _whole(logs)
                r = np.exp(logs - whole[:, None])
                squares = [(own * r[:, [k]]).T @ own for k in range(r.shape[1])] if kinds[a] == "full" else [r.T @ (own * own)]
                yield np.concatenate([r.sum(axis=0), (r.T @ own).ravel(), *[s.ravel() for s in squares], [len(own), whole.sum()]])

        for a, total in zip(alive, _summed(rows, sizes, moments), strict=True):
            models[a] = _updated(total, grid[a[0]]["k"], d, kinds[a], ridge, models[a])
        alive = [a for a in alive if len(models[a].history) < 2 or abs(models[a].history[-1] - models[a].history[-2]) >= tolerance]
        if not alive:
            break
    judged = [(c, f) for c in range(len(grid)) for f in range(folds)]

    def held(x: np.ndarray, fold: np.ndarray):
        for c, f in judged:
            own = x[fold == f]
            yield np.array([len(own), _whole(_logs(own, models[c, f], grid[c].get("kind", "full"))).sum() if len(own) else 0.0])

    found = dict(zip(judged, _summed(rows, [2] * len(judged), held), strict=True))
    scores = []
    for c, g in enumerate(grid):
        each = [float(found[c, f][1] / found[c, f][0]) for f in range(folds) if found[c, f][0]]
        scores.append((g, sum(each) / len(each), each))
    best = max(range(len(grid)), key=lambda c: round(scores[c][1], 12))
    return Searched(grid[best], scores, models[best, -1])
