"""Places in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.storage import written


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with out: each row's place from 0. Ranges of rows are counted, then numbered one by one; order must have no ties."""
    parts = written(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_start")
    return parts.join(starts, "_part").withColumn(out, place).drop("_part", "_start")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with each key of sums: the sum of its column over the rows up to and with each row, which must not tie.

    Ranges of rows are summed first, so that no task holds more than one range.
    """
    parts = written(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_of_{out}") for out, c in sums.items()])  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(totals.select("_part", *[F.coalesce(F.sum(f"_of_{out}").over(before), F.lit(0)).alias(f"_of_{out}") for out in sums]))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    up = parts.join(starts, "_part").withColumns({out: F.sum(c).over(own) + F.col(f"_of_{out}") for out, c in sums.items()})
    return up.drop("_part", *[f"_of_{out}" for out in sums])


def running_sums_within(df: DataFrame, group: list[str], value: str, sums: list[str], following: str) -> DataFrame:
    """df with, for each column c of sums, up_c (its sum over the group's rows up to this value) and all_c (over the group), and the next value.

    Values must not tie within a group, and group columns not be null. Ranges of (group, value) are summed first, so a
    group of any size lies in many tasks.
    """
    parts = written(df.repartitionByRange(*group, value).select("*", F.spark_partition_id().alias("_part")))
    totals = parts.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_of_{c}") for c in sums], F.min(value).alias("_first"))
    whole = Window.partitionBy(*group)  # a row a range of the group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_part", F.lead("_first").over(whole.orderBy("_part")).alias("_next"), *[F.coalesce(F.sum(f"_of_{c}").over(before), F.lit(0)).alias(f"_from_{c}") for c in sums], *[F.sum(f"_of_{c}").over(whole).alias(f"all_{c}") for c in sums])
    own = Window.partitionBy("_part", *group).orderBy(value)
    up = parts.join(starts, [*group, "_part"]).withColumns({f"up_{c}": F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_from_{c}") for c in sums} | {following: F.coalesce(F.lead(value).over(own), F.col("_next"))})
    return up.drop("_part", "_next", *[f"_from_{c}" for c in sums])


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; nulls are left out, and without values all are null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    up = running_sums(counts, [F.col("v")], {"upto": "n"})
    n = up.agg(F.max("upto")).head()[0]
    if n is None:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ends = up.agg(*[F.min(F.when(F.col("upto") > place, F.col("v"))) for a in at for place in (int(a), min(int(a) + 1, n - 1))]).head()
    return [ends[2 * k] + (ends[2 * k + 1] - ends[2 * k]) * (a - int(a)) for k, a in enumerate(at)]


def placed(df: DataFrame, group: str, hashed: Column, key: str, width: int = 1 << 31) -> DataFrame:
    """df with _place, from 1 within the group by a hash below width and then key, and _size, the group's rows.

    A group is cut in 256 ranges of the hash, which are counted before they are numbered, so no task holds a group.
    """
    cut = df.withColumn("_h", hashed).withColumn("_range", F.floor(F.col("_h") / F.lit(width // 256)))
    counts = cut.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_size"))
    own = Window.partitionBy(group, "_range").orderBy("_h", key)
    joined = cut.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_place", F.row_number().over(own) + F.col("_start")).drop("_h", "_range", "_g", "_r", "_start")
