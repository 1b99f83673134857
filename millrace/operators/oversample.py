"""Synthetic rows of a rare class (SMOTE, and SMOTENC with categorical columns) from neighbours of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_bucket
from millrace.functions.ranks import numbered
from millrace.sources.storage import written

#: Rows of a stretch along a direction; a row meets those of its half of it and of the halves beside. Directions.
STRETCH, DIRECTIONS = 512, 12
#: Halves that a task compares at a time; rows of the outer ones are sent to the task beside, too.
HALVES = 32


def _nearest(numeric: list[str], categorical: list[str], k: int, penalty: float, half: int):
    """The k nearest of each wanted row, by squared distance and penalty for each other category; equal ones by key."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        keys, at = table["key"].to_numpy(), table["at"].to_numpy() // half
        wanted = np.flatnonzero(table["wanted"].to_numpy() & (at // HALVES == key[1].as_py()))
        x = [table[c].to_numpy() for c in numeric]
        v = [pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy() for c in categorical]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for h in np.unique(at[wanted]):
            rows = wanted[at[wanted] == h]
            lo, hi = np.searchsorted(at, [h - 1, h + 2])
            near = lo + np.argsort(keys[lo:hi])
            if (most := min(k, len(near) - 1)) < 1:
                continue
            d = np.zeros((len(rows), len(near)))
            for c in x:
                d += (c[rows][:, None] - c[near][None, :]) ** 2
            for c in v:
                d += penalty * (c[rows][:, None] != c[near][None, :])
            d = np.round(d, 9)
            d[rows[:, None] == near[None, :]] = np.inf
            one, other = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 :][:, :1])
            order = np.lexsort((other, d[one, other], one))
            one, other = one[order], other[order]
            first = np.arange(len(one)) - np.searchsorted(one, one) < most
            one, other = one[first], other[first]
            found.append((keys[rows], np.bincount(one, minlength=len(rows)), keys[near[other]], d[one, other]))
        base, sizes, other, d = (np.concatenate(f) for f in zip(*found, strict=True))
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        return pa.table({"key": base, "d": pa.ListArray.from_arrays(ends, pa.array(d)), "other": pa.ListArray.from_arrays(ends, pa.array(other))})

    return run


def _near(rows: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int, penalty: float, seed: int, stretch: int, wanted: Column | None) -> DataFrame:
    """(key, near) of the wanted rows: about their k nearest as an array of (d, other), the nearest first."""
    source = written(rows.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in numeric], *categorical, (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("wanted")))
    n, draw, ways = source.count(), np.random.default_rng(seed), []
    for t in range(1 if n <= stretch else DIRECTIONS):
        place = sum((F.col(c) * float(w) for c, w in zip(numeric, draw.normal(size=len(numeric)), strict=True)), F.lit(0.0))
        for j, c in enumerate(categorical):
            place = place + F.lit(float(np.sqrt(penalty))) * (hash_bucket(F.coalesce(F.col(c).cast("string"), F.lit("")), seed + 100 * t + j, 1000) / 1000.0)
        ways.append(F.struct(F.lit(t).alias("t"), place.alias("place")))
    half = max(n, 1) if n <= stretch else max(stretch // 2, 1)
    # all directions in one order; each has n rows
    placed = numbered(source.select("*", F.explode(F.array(*ways)).alias("_way")).select("*", "_way.t", "_way.place").drop("_way"), [F.col("t"), F.col("place"), F.col("key")], "at")
    placed = placed.drop("place").withColumn("at", F.col("at") - F.col("t") * n)
    h = F.floor(F.col("at") / half)
    own = F.floor(h / HALVES)
    edge = h - own * HALVES
    beside = F.array(own, F.when((edge == 0) & (own > 0), own - 1), F.when(edge == HALVES - 1, own + 1))
    dealt = placed.withColumn("part", F.explode(F.array_compact(beside)))
    parts = dealt.groupBy("t", "part").applyInArrow(_nearest(numeric, categorical, k, penalty, half), "key long, d array<double>, other array<long>")
    return parts.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("d", "other"))))), 1, k).alias("near"))


def class_neighbours(rows: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int, penalty: float = 0.0, seed: int = 0, stretch: int = STRETCH, wanted: Column | None = None) -> DataFrame:
    """(key, other, d, rank): about the k nearest rows of each row, by squared distance over numeric columns without nulls.

    Rows are ordered along several seeded directions (categories count by a hash) and compared within overlapping
    stretches, so a task holds some stretches and no pair of far rows is made. A table of at most one stretch is exact;
    beyond that a neighbour is missed if no direction keeps it near. Keys are unique longs. wanted: a condition on the
    rows whose neighbours are sought, among all rows; by default all.
    """
    found = _near(rows, key, numeric, categorical, k, penalty, seed, stretch, wanted)
    return found.select("key", F.posexplode("near")).select("key", "col.other", "col.d", (F.col("pos") + 1).alias("rank"))


def _most_frequent(values: Column) -> Column:
    """The most frequent one of an array's values, nulls included, the smallest of equally frequent ones."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda o: o.eqNullSafe(v)))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def smote(df: DataFrame, key: str, label: str, rare, numeric: list[str], categorical: list[str] = (), k: int = 5, size: int | None = None, seed: int = 0) -> DataFrame:
    """size new rows of class rare (by default as many as it lacks to the largest class): (numeric, categorical, label).

    A new row lies between a row of the class and one of its k nearest, both and the place between drawn by hash;
    another category counts as the square of the median of the numeric columns' deviations in the class. Its categories are the most frequent of the k neighbours, the smallest of equally
    frequent ones. Rows with a null in a numeric column take no part. A class of fewer than two rows is an error.
    Neighbours are sought for drawn rows only.
    """
    numeric, categorical = list(numeric), list(categorical)
    counts = {r[0]: r.n for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    own = df.where(F.col(label) == rare).dropna(subset=numeric)
    known = own.agg(F.count("*").alias("_n"), *[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numeric]).head()
    n = known["_n"]
    if n < 2:
        raise ValueError("fewer than two rows of the class")
    lacking = max(counts.values()) - counts[rare] if size is None else size
    values = own.select(F.col(key).cast("long").alias("_key"), *[F.col(c).cast("double").alias(c) for c in numeric], *categorical)
    if lacking <= 0:
        return values.where(F.lit(False)).select(*numeric, *categorical, F.lit(rare).alias(label))
    middle = float(np.median([known[c] or 0.0 for c in numeric])) if numeric else 1.0
    draws = df.sparkSession.range(lacking).select(F.col("id").alias("draw"), hash_bucket(F.col("id"), seed + 1, n).alias("_place"))
    drawn = draws.select("_place").distinct().withColumn("_drawn", F.lit(True))
    rows = written(numbered(values, [F.col("_key")], "_place").join(drawn, "_place", "left"))
    near = _near(rows, "_key", numeric, categorical, k, middle**2, seed, STRETCH, F.col("_drawn"))
    # a drawn row with its neighbours' values, so that a draw meets one row
    ends = rows.select(F.col("_key").alias("_other"), F.struct(*[F.col(c) for c in [*numeric, *categorical]]).alias("_to"))
    links = near.select(F.col("key").alias("_key"), F.posexplode("near")).select("_key", "pos", F.col("col.other").alias("_other")).join(ends, "_other")
    around = links.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_to"))), lambda s: s["_to"]).alias("_near"))
    most = [_most_frequent(F.col("_near").getField(c)).alias(c) for c in categorical]
    based = written(rows.where("_drawn").drop(*categorical).join(around, "_key").select("_place", *numeric, "_near", *most))
    rank = (hash_bucket(F.col("draw"), seed + 2, 1 << 30) % F.size("_near")).cast("int")
    made = draws.join(based, "_place").withColumns({"_u": hash_bucket(F.col("draw"), seed + 3, 1 << 30) / (1 << 30), "_to": F.get("_near", rank)})
    between = [(F.col(c) + F.col("_u") * (F.col("_to")[c] - F.col(c))).alias(c) for c in numeric]
    return made.select(*between, *categorical, F.lit(rare).alias(label))
