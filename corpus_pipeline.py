"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files. Part of subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate as leaks
from millrace.llm import langid, mixing, near_dedup, queries, token_files
from millrace.llm.common import maybe_broadcast, row_key, settled, written


def _keyed(docs: DataFrame) -> DataFrame:
    """(_row, _key): each row of docs as a struct, so that its columns clash with none of ours, and its row_key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key("doc_id", "text").alias("_key"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs whose row_key(doc_id, text) is not in keys (_key); no shuffle of texts while keys are few."""
    gone = maybe_broadcast(written(keys.select("_key").distinct()))
    return _keyed(docs).join(gone, "_key", "left_anti").select("_row.*")


def _once(keyed: DataFrame, again: DataFrame) -> DataFrame:
    """Keyed rows, one of each key in again (a written table of _key)."""
    if not again.limit(1).count():
        return keyed
    once = keyed.join(maybe_broadcast(again), "_key", "left_semi").dropDuplicates(["_key"])
    return keyed.join(maybe_broadcast(again), "_key", "left_anti").select("_row", "_key").unionByName(once.select("_row", "_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes what was identified. Null texts are unknown and go."""
    judged = settled(spark, lambda: langid.identify_languages(docs))
    kept = _without(docs, judged.where("not kept"))
    other = judged.where("kept and language is distinct from declared").select("_key", "language").dropDuplicates(["_key"])
    fixed = _keyed(kept).join(maybe_broadcast(written(other)), "_key", "left")
    return fixed.select(F.col("_row").withField("lang", F.coalesce("language", F.col("_row.lang"))).alias("_row")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; of rows that repeat it, one.

    Rows of one doc_id with different texts are different documents. Null ids and texts without words are in no group
    and stay.
    """
    judged = settled(spark, lambda: near_dedup.near_duplicates(docs).select("doc_id", "_key", "_group"))
    firsts = judged.where("_group is not null").groupBy("_group").agg(F.min(F.struct("doc_id", "_key")).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1").select("_group", "first._key"))
    gone = judged.join(maybe_broadcast(firsts.select("_group", F.col("_key").alias("_first"))), "_group").where("_key <> _first")
    kept = _without(docs, gone)
    again = written(judged.where("_group is not null").join(maybe_broadcast(firsts.select("_key")), "_key", "left_semi").groupBy("_key").count().where("count > 1").select("_key"))
    return _once(_keyed(kept), again).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item. Null texts have none and stay."""
    return _without(docs, settled(spark, lambda: leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("_key").distinct()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Equal rows are emitted as often as all of them together; null texts have size 0."""
    counts = [F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")]
    drawn = settled(spark, lambda: mixing.mix(docs).groupBy("_key").agg(*counts).where("copies <> 1 or n <> 1"))
    keyed = _once(_keyed(docs), written(drawn.where("n > 1").select("_key")))
    counted = keyed.join(maybe_broadcast(drawn.select("_key", "copies")), "_key", "left").select("_row", F.coalesce("copies", F.lit(1)).alias("copies"))
    return counted.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token files. Null texts are encoded as empty ones."""
    return token_files.read_token_files(spark, token_files.write_token_files(docs, queries.tokenizer_path(), queries.END_ID))


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("token_output", token_output)]

#: Model fitting, MinHash and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
