"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, prefix_sums, ranked, row_key, words, written

#: Weights of the sources in their order, repeating; a source is taken at most so many times.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = 20240607


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target, from sizes (source, source_size): shares of the total by weight.

    A target stops at most times its source's size and the excess is shared by weight among the others, again until
    none is above. Each round is one aggregation over the sources; two numbers come back.
    """
    table = ranked(sizes, [F.col("source").asc_nulls_last()], "_place")
    table = written(table.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int")).cast("double")))
    total, open_weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).head()
    share = total / open_weight if open_weight else 0.0
    while True:
        above = F.col("w") * share > most * F.col("source_size")
        capped, left = table.agg(F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).head()
        after = (total - capped) / left if left else share
        if after <= share:
            break
        share = after
    return table.select("source", "source_size", F.least(F.col("w") * share, (most * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, _key, size, source_size, target, copies and taken of every row of docs (doc_id, text, source).

    Within a source, in order of size, each document's expected copies (target / source size) are summed up; with one
    random offset, it is emitted once for each whole number that the sum crosses. As neighbours are of like size, the
    words taken are near the target. Copies never exceed most. Null texts have size 0; documents of a source without
    words get no copies. The null source is the last one. Offsets and ties are drawn by hashes of seed, so reruns agree.
    _key is row_key(doc_id, text); rows that repeat are drawn one by one.
    """
    slim = written(docs.select("doc_id", row_key("doc_id", "text").alias("_key"), "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    plan = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    null, name = F.col("source").isNull().cast("int").alias("_null"), F.coalesce("source", F.lit("")).alias("_name")
    tie = F.xxhash64("_key", F.lit(seed))
    blocks = F.floor(F.pmod(tie, F.lit(1 << 40)) / (1 << 20)).cast("long")  # 2**20 of them, fewer if a size is rare
    rows = slim.select("doc_id", "_key", "size", null, name, tie.alias("_tie"), F.lit(1).cast("long").alias("_one"), blocks.alias("_block"))
    rows = prefix_sums(rows, [["_null", "_name"], ["size"], ["_block"]], ["_tie", "_key", "doc_id"], "_one", "_before")
    plan = plan.select("*", null, name).drop("source")
    rows = rows.join(maybe_broadcast(written(plan)), ["_null", "_name"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64("_name", "_null", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor((F.col("_before") + 1) * rate + offset) - F.floor(F.col("_before") * rate + offset)
    return rows.select("doc_id", "_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
