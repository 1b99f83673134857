"""Embedding whitening: moments merged pairwise (Chan), eigenvectors on the driver, a second pass that verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries are floor(SCALE * value); components returned; eigenvalues below this share of their sum count as zero.
SCALE, COMPONENTS, ZERO = 256, 4, 1e-12


class Moments(NamedTuple):
    """Count, exact sums, least and largest entries, and mean and centred scatter of what they are projected on."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    mean: np.ndarray
    scatter: np.ndarray


class Whitening(NamedTuple):
    """Fitted from n distinct vectors with these sums; vectors: components by row, with falling values. widest: bounds of |n * x - sum|."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    widest: list[int]


def whole_numbers(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry c as a double, as array<long>; null if the vector or an entry is null, or an entry not finite.

    What a long cannot hold becomes the nearest long.
    """
    c = F.col(vector) if isinstance(vector, str) else vector
    c = F.transform(c, lambda e: e.cast("double"))
    good = c.isNotNull() & F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    return F.when(good, F.transform(c, lambda e: F.floor(e * float(scale)).cast("long")))


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the moments of both lots together."""
    n, apart = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n)
    whole = [[f(x, y) for x, y in zip(p, q, strict=True)] for f, p, q in ((int.__add__, a.sums, b.sums), (min, a.low, b.low), (max, a.high, b.high))]
    return Moments(n, *whole, a.mean + apart * (b.n / n), scatter)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of long vectors; entries that shorter vectors lack are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _summary(x: np.ndarray, values: np.ndarray) -> Moments:
    mean = values.mean(axis=0)
    centred = values - mean
    large = np.abs(x.astype(np.float64)).max() * len(x) > 2.0**62
    sums = (x.astype(object) if large else x).sum(axis=0)
    return Moments(len(x), [int(s) for s in sums], x.min(axis=0).tolist(), x.max(axis=0).tolist(), mean, centred.T @ centred)


def _partition(batches: Iterator[pa.RecordBatch], width: int, project) -> Iterator[pa.RecordBatch]:
    """One row for each partition that has vectors: its moments, batch by batch."""
    have = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0), width)
            own = _summary(x, project(x))
            have = merged(have, own) if have else own
    if have:  # sums are sent as text, as they may be longer than a long
        yield pa.RecordBatch.from_pydict({"n": [have.n], "sums": [[str(s) for s in have.sums]], "low": [have.low], "high": [have.high], "mean": [have.mean.tolist()], "scatter": [have.scatter.ravel().tolist()]})


def _plain(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64)


def moments(vectors: DataFrame, width: int, project=_plain) -> Moments:
    """The moments of project(x) over the column x of a table that has rows; partitions are merged pairwise in a tree.

    A partition sends width sums, minima and maxima and k + k * k numbers for k projected columns, whatever its rows.
    """
    schema = "n long, sums array<string>, low array<long>, high array<long>, mean array<double>, scatter array<double>"
    each = vectors.select("x").mapInArrow(partial(_partition, width=width, project=project), schema)

    def parsed(r) -> Moments:
        mean = np.array(r.mean)
        return Moments(r.n, [int(s) for s in r.sums], r.low, r.high, mean, np.array(r.scatter).reshape(len(mean), len(mean)))

    return each.rdd.map(parsed).treeReduce(merged)


def fit(lists: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct vectors x (array<long>); None if no vector has an entry.

    Shorter vectors are filled with zeros. The driver holds one covariance matrix: width squared numbers.
    """
    width = lists.agg(F.max(F.size("x"))).head()[0] or 0
    if not width:
        return None
    whole = moments(lists, width)
    values, vectors = np.linalg.eigh(whole.scatter / whole.n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    widest = [max(whole.n * h - s, s - whole.n * w) for s, w, h in zip(whole.sums, whole.low, whole.high, strict=True)]
    return Whitening(whole.n, whole.sums, vectors * signs[:, None], values, float(np.trace(whole.scatter) / whole.n), widest)


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x less the mean, on each component, over the root of its eigenvalue; NaN where that is zero."""
    mean = np.array([s / model.n for s in model.sums])
    root = np.where(model.values > ZERO * model.trace, np.sqrt(np.maximum(model.values, 0)), np.nan)
    return ((x.astype(np.float64) - mean) @ model.vectors.T) / root


def _firsts(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return _project(x, model)[:, :k]


def identity_error(lists: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened distinct vectors' covariance less the identity, from a second pass over them.

    Components without variance are left out; None if there is no other.
    """
    k = int((model.values > ZERO * model.trace).sum()) if model.trace > 0 else 0
    if not k:
        return None
    again = moments(lists, len(model.sums), partial(_firsts, model=model, k=k))
    return float(np.abs(again.scatter / again.n - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n * x - sum) squared, exact; null if a long cannot hold it."""
    if sum(w * w for w in model.widest) < 2**63 and model.n * max(map(abs, model.sums), default=0) < 2**62:
        return ((x * model.n - np.array(model.sums)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * model.n - np.array(model.sums, object)) ** 2).sum(axis=1)
    return [int(e) if e < 2**63 else None for e in exact]


def _apply(batches: Iterator[pa.RecordBatch], model: Whitening, error: float | None) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    for batch in batches:
        x = _matrix(batch.column("x"), len(model.sums))
        at = np.repeat(np.arange(len(x)), k)
        white = _project(x, model).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), model.n, np.int64)),
                pa.array(_deviations(x, model), pa.int64()).take(pa.array(at)),
                pa.array(white, mask=np.isnan(white)),
                pa.array(explained * len(x), pa.float64()),
                pa.array([error] * len(at), pa.float64()),
            ],
            names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of each row and each of the first components.

    Rows whose vector is null or has a null or non-finite entry are dropped; ids may be null or repeat, each row is
    answered. Vectors of several lengths are filled with zeros to the longest. No component: no rows (empty table, or
    no entries). Without variance (one distinct vector, or fewer than components directions) whitened is null, and so
    is explained if the trace is zero. deviation is null where a long cannot hold it. Other columns are not read.
    """
    rows = written(df.select(F.col(id_column).alias("id"), whole_numbers(vector, scale).alias("x")).where("x is not null"))
    lists = written(rows.select("x").distinct())
    model = fit(lists, components)
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    error = identity_error(lists, model)
    return rows.mapInArrow(partial(_apply, model=model, error=error), schema).withColumnRenamed("id", id_column)
