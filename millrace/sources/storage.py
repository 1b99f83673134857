"""Tables between the steps of iterative algorithms."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints/millrace"  # one machine, as in tests
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files that this took are removed as soon as it is done.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(_SWEPT, None)
    spark.conf.set(_SWEPT, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_SWEPT) if before is None else spark.conf.set(_SWEPT, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables, which nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
