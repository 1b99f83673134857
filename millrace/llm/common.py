"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The contract's white space, as a Java pattern and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"

#: Rows up to which a written table is broadcast; a row of these tables has a few numbers or a short string.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that driver and executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints/millrace"  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Paths of the tables that are written within each settled() that is under way.
_made: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of build(), written; tables that were written on the way are deleted, as nothing reads them again."""
    made: list[str] = []
    _made.append(made)
    try:
        rows = build()
    finally:
        _made.pop()
    out = written(rows)
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return out


def give_back() -> None:
    """Returns a Python worker's free memory to the machine; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def maybe_broadcast(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, with a broadcast hint if its counted rows are few enough; else Spark shuffles both sides."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's content, as text. Equal rows have equal keys and so equal results."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once a row however often body names it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words between the contract's white space; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _paired(a: Column, b: Column, shift: int) -> Column:
    """Hashes of a[i] and b[i + shift], as many as there are such pairs."""
    n = F.greatest(F.lit(0), F.size(b) - shift)
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """A 64-bit hash for each run of width words, in order; empty if there are fewer words.

    Word hashes are joined pairwise (2, 4, 8 words), so a run costs a few hashes of numbers, not of strings.
    """
    first = F.transform(tokens, lambda w: F.xxhash64(w))
    if width == 1:
        return first

    def grown(h: Column, one: Column, have: int) -> Column:
        if have == width:
            return h
        if 2 * have <= width:
            return let(_paired(h, h, have), lambda g: grown(g, one, 2 * have))
        return let(_paired(h, one, have), lambda g: grown(g, one, have + 1))

    return let(first, lambda h: grown(h, h, 1))


def prefix_sums(df: DataFrame, levels: list[list[str]], order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows before, within levels[0], by levels[1:] and then order.

    Each level's groups are summed first and their totals are prefix-summed, so no task holds more than one
    finest group of rows, or the groups below one group of the next level. df is read once for each use: give a
    written table. Key columns must not be null.
    """
    keys = [sum(levels[: k + 1], []) for k in range(len(levels))]
    offsets = None
    totals = df.groupBy(*keys[-1]).agg(F.sum(value).alias("_total"))
    for k in range(1, len(levels)):
        table = totals if k == len(levels) - 1 else totals.groupBy(*keys[k]).agg(F.sum("_total").alias("_total"))
        before = Window.partitionBy(*keys[k - 1]).orderBy(*levels[k]).rowsBetween(Window.unboundedPreceding, -1)
        table = table.select(*keys[k], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(f"_off{k}"))
        offsets = table if offsets is None else table.join(offsets, keys[k - 1])
    own = Window.partitionBy(*keys[-1]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    if offsets is None:
        return df
    steps = [f"_off{k}" for k in range(1, len(levels))]
    total = F.col(out)
    for s in steps:
        total = total + F.col(s)
    return df.join(offsets, keys[-1]).withColumn(out, total).drop(*steps)


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """A written copy of df with out: each row's place from 0 by order. Range partitions are numbered one by one."""
    parts = written(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_start")
    return written(parts.join(starts, "_part").withColumn(out, place).drop("_part", "_start"))
