"""The registered queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, langid, mixing, near_dedup, oracles, pii, quality, repair, token_files, toxicity, urls, warc, whitening

END_ID = 0


def tokenizer_path() -> str:
    """The vocabulary file of the registered queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents")).drop("_key")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages"))


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op5_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = pii.KINDS[:4]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s.kind.isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_max("spans.score").alias("top_score"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("_key")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, path)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("_key", "_group")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.judge(table(spark, sf_dir, "conversations"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontaminate, op3_extract_text, op4_filter_urls, op5_find_pii, op6_mix, op7_token_files, op8_quality, op9_near_dedup, op10_warc,
        op11_repair, op12_whiten, op13_toxicity,
    )
}
#: The others rest on fitted models, hashes of Spark or binary formats; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op8_quality": oracles.QUALITY, "op9_near_dedup": oracles.NEAR_DUPLICATES}
