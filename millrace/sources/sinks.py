"""Result tables as text files, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated files with a header; numbers keep all digits, null is an empty field."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, path: str, order: list[str]) -> None:
    """One Markdown table in one text file, rows in order; for result tables that fit in a task. Null is an empty cell, | is escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = df.orderBy(*order).select(F.monotonically_increasing_id().alias("at"), line.alias("value"))
    head = [(-2, f"| {' | '.join(df.columns)} |"), (-1, "|" + "-|" * len(df.columns))]
    lines = df.sparkSession.createDataFrame(head, "at long, value string").unionByName(body)
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
