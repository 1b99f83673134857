"""Decisions between equal sums do not depend on the order in which they are added up."""

from pyspark.sql import functions as F

from millrace.operators import nary


def test_pruning_sees_equal_hits_in_shares(spark):
    """All leaves say the same class, so that no split gains hits, however many shares are added up."""
    h = lambda seed, n: F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(n))
    df = spark.range(600_000).withColumnRenamed("id", "k")
    df = df.select("k", F.when(h(1, 10) > 0, h(2, 300).cast("double")).alias("v"), F.when(h(3, 7) > 0, h(4, 13).cast("string")).alias("c"), (h(5, 40) > 0).cast("int").alias("y"))
    tree = nary.grow_nary(df.where("k % 4 > 0"), "y", ["v"], ["c"], [0, 1], depth=2)
    assert tree.shape().head().nodes > 1
    assert tree.pruned(df.where("k % 4 = 0"), "k", "y").shape().head().nodes == 1
