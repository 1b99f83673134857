"""Tables from files: the driver's Parquet tables, delimited text in its variants, and rating lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, header: bool = True, sep: str = ",", missing: str = "?") -> DataFrame:
    """Delimited text with a given schema; the marker and blanks around values are missing or dropped."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, nullValue=missing, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def sniff_separator(spark: SparkSession, path: str, candidates: str = ";\t,") -> str:
    """The candidate that the first line has most of; a comma if it has none."""
    first = spark.read.text(path).head()
    line = first.value if first else ""
    best = max(candidates, key=line.count)
    return best if best in line else ","


def read_rating_lines(spark: SparkSession, path: str, comment: str = "%", shift: int = 0) -> DataFrame:
    """(user, item, rating) from lines of white-space separated triples; comments and malformed lines are left out.

    shift is taken from both ids (1 turns ids from 1 into ids from 0).
    """
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit(comment)) & (F.trim("value") != ""))
    rows = lines.select(*[F.get(parts, k).alias(n) for k, n in enumerate(("user", "item", "rating"))])
    return rows.select(*[(F.col(n).try_cast("bigint") - shift).alias(n) for n in ("user", "item")], F.col("rating").try_cast("double").alias("rating")).dropna()


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at path, built and written first if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        build().write.parquet(path)
        return spark.read.parquet(path)
