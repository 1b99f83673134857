"""Principal components and latent semantics by subspace iteration: the driver holds columns times components numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.storage import written


@dataclass
class Projection:
    """names: the columns' keys, sorted; mean by column; vectors by component, with falling values; total: the trace."""

    names: list
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    total: float

    def explained(self) -> list[float]:
        return [float(v / self.total) if self.total else 0.0 for v in self.values]


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column place and value of the cells of a batch of sparse rows (at, x)."""
    at = batch.column("at")
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), at.flatten().to_numpy(), batch.column("x").flatten().to_numpy()


def _times(rows: DataFrame, q: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """(X - mean)' (X - mean) q, from one pass over sparse rows."""
    k = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(q)
        for batch in batches:
            row, at, x = _lists(batch)
            z = np.zeros((batch.num_rows, k))
            for c in range(k):
                z[:, c] = np.bincount(row, x * q[at, c], batch.num_rows) - mean @ q[:, c]
                total[:, c] += np.bincount(at, x * z[row, c], len(q))
            total -= np.outer(mean, z.sum(axis=0))
        cells = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(total[cells, c]) for c in range(k)]], ["at", *[f"s{c}" for c in range(k)]])

    found = rows.mapInArrow(run, ", ".join(["at long", *[f"s{c} double" for c in range(k)]])).groupBy("at").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(k)]).toArrow()  # a row a column
    out = np.zeros_like(q)
    out[found["at"].to_numpy()] = np.stack([found[f"s{c}"].to_numpy() for c in range(k)], axis=1)
    return out


def sparse_rows(cells: DataFrame, row: str, column: str, value: str) -> tuple[DataFrame, list]:
    """(written rows (row, at, x), the columns' keys in order) of a table of cells; a row holds its own cells only.

    The keys of all columns come to the driver, as the projection has a number for each anyway.
    """
    names = [r[0] for r in cells.select(column).distinct().orderBy(column).collect()]
    kind = cells.schema[column].dataType.simpleString()
    places = cells.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{column} {kind}, _at int")
    cell = F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), F.col(value).cast("double").alias("x"))))
    rows = cells.join(places, column).groupBy(F.col(row).alias("row")).agg(cell.alias("c"))
    return written(rows.select("row", F.col("c.at").alias("at"), F.col("c.x").alias("x"))), names


def principal(rows: DataFrame, names: list, k: int, centred: bool = True, rounds: int = 30, tolerance: float = 1e-9, extra: int = 8, seed: int = 0) -> Projection:
    """The k leading directions of sparse rows (at, x): of the covariance if centred (divisor n), else of X'X.

    Each round multiplies a block of k + extra directions in one pass and makes it orthonormal on the driver, until the
    values move by less than tolerance of their largest. No matrix of columns by columns is made. Signs: the largest
    entry of a direction is positive.
    """
    d = len(names)
    n, sums, squares = rows.count(), np.zeros(d), 0.0
    if not n or not d:
        return Projection(names, np.zeros(d), np.zeros((0, d)), np.zeros(0), 0.0)
    each = rows.select(F.explode(F.arrays_zip("at", "x")).alias("c")).groupBy("c.at").agg(F.sum("c.x").alias("s"), F.sum(F.col("c.x") * F.col("c.x")).alias("q"))
    for r in each.collect():  # a row a column
        sums[r.at], squares = r.s, squares + r.q
    mean = sums / n if centred else np.zeros(d)
    width = min(d, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    values = np.zeros(width)
    for _ in range(rounds):
        y = _times(rows, q, mean)
        inner, turn = np.linalg.eigh(q.T @ y)
        order = np.argsort(-inner)
        moved, values = np.abs(inner[order] - values)[:k].max(), inner[order]
        q = np.linalg.qr(y @ turn[:, order])[0]
        if moved <= tolerance * max(values[0], 1e-300):
            break
    y = _times(rows, q, mean)
    inner, turn = np.linalg.eigh(q.T @ y)
    order = np.argsort(-inner)[: min(k, width)]
    vectors = (q @ turn[:, order]).T
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    scale = n if centred else 1
    return Projection(names, mean, vectors, np.maximum(inner[order], 0) / scale, float(squares - n * mean @ mean) / scale)


def projected(rows: DataFrame, model: Projection) -> DataFrame:
    """(row, f): each sparse row's coordinates."""
    k = len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, x = _lists(batch)
            z = np.stack([np.bincount(row, x * model.vectors[c, at], batch.num_rows) - model.mean @ model.vectors[c] for c in range(k)], axis=1) if k else np.zeros((batch.num_rows, 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * k, pa.array(z.ravel()))], ["row", "f"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, f array<double>")


def dense_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sparse rows of a table of columns without nulls."""
    return written(df.select(F.col(key).alias("row"), F.array(*[F.lit(k) for k in range(len(columns))]).alias("at"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")))


def content_profiles(ratings: DataFrame, items: DataFrame) -> tuple[float, DataFrame]:
    """(mean, (user, f)): each user's mean of the factors (row, f) of what they rated, by how far the rating is from the mean of all."""
    mean = ratings.agg(F.avg("rating")).head()[0] or 0.0
    rank = items.agg(F.max(F.size("f"))).head()[0] or 0
    joined = ratings.join(items.withColumnRenamed("row", "item"), "item")
    means = joined.groupBy("user").agg(F.array(*[F.avg((F.col("rating") - mean) * F.get("f", F.lit(k))) for k in range(rank)]).alias("f"))
    return float(mean), means


def content_scores(pairs: DataFrame, mean: float, profiles: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (user, item, ...) with score: mean and the product of the profile and the item's factors; the mean where one lacks."""
    u, i = profiles.select("user", F.col("f").alias("_p")), items.select(F.col("row").alias("item"), F.col("f").alias("_q"))
    product = F.aggregate(F.zip_with("_p", "_q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(u, "user", "left").join(i, "item", "left").withColumn("score", F.lit(mean) + F.coalesce(product, F.lit(0.0))).drop("_p", "_q")
