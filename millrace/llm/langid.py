"""Language identification by Bayesian fusion of evidence.

log P(language | text, declared, host) = text likelihood + P(declared | language) + host prior, up to a constant.
The text likelihood is a byte-trigram model; the other two are counts of a grouped aggregation over all documents,
the host's smoothed towards its address suffix and the suffix's towards all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

#: Labelled documents of each language that the trigram model is fitted on, at most about so many.
TRAIN_PER_LANGUAGE = 1500
#: A language has a model if documents that declare it have so many characters in all; there may be any number of them.
MIN_CHARS = 10_000
#: Languages whose counts a task holds before it hands them on.
HELD_LANGUAGES = 64
BUCKETS = 1 << 16
#: Trigrams that one text counts as: one in OVERLAP, as each letter is in three of them, and EVIDENCE at most, as words
#: repeat and long texts would drown the rest.
OVERLAP, EVIDENCE = 3.0, 60.0
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
MIN_POSTERIOR = 0.5


def _trigrams(data: np.ndarray) -> np.ndarray:
    """A bucket for each byte from the third on. Digits are one byte, other ASCII signs are spaces."""
    x = _FOLD[data].astype(np.uint32)
    return ((x[:-2] * np.uint32(2_654_435_761) + x[1:-1] * np.uint32(40_503) * np.uint32(65_599) + x[2:] * np.uint32(2_246_822_519)) >> np.uint32(16)).astype(np.int32)


_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _c = chr(_b)
    _FOLD[_b] = ord(_c.lower()) if _c.isalpha() else 32


def _pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their bytes (a space before each text and two after) and each text's length, about most bytes a run.

    A longer text is a run of its own.
    """
    low, held, parts = 0, 0, []
    for k, text in enumerate(batch.column(column)):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if parts and held + len(raw) > most:
            yield low, k, np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
            low, held, parts = k, 0, []
        parts.append(b" " + raw + b"  ")
        held += len(raw)
    if parts:
        yield low, batch.num_rows, np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def counts() -> Iterator[pa.RecordBatch]:
        for k, n in held.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), k, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        of = batch.column(0).to_pylist()
        for low, high, data, sizes in _pieces(batch, 1):
            ends = np.cumsum(sizes)
            for k in range(low, high):
                a, b = ends[k - low] - sizes[k - low], ends[k - low]
                if of[k] not in held:
                    if len(held) >= HELD_LANGUAGES:
                        yield from counts()
                    held[of[k]] = np.zeros(BUCKETS, np.int64)
                held[of[k]] += np.bincount(_trigrams(data[a:b]), minlength=BUCKETS)
    yield from counts()


def _scored(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, letters = np.zeros((batch.num_rows, table.shape[1]), np.float64), np.zeros(batch.num_rows, np.int64)
            for low, high, data, sizes in _pieces(batch, 4):
                starts = np.cumsum(sizes) - sizes
                t = _trigrams(np.concatenate([data, np.full(2, 32, np.uint8)]))
                useful = _FOLD[data] != 32  # a trigram counts if it begins with a letter, so none reaches the next text
                for j in range(table.shape[1]):
                    scores[low:high, j] = np.add.reduceat(table[t, j] * useful, starts)
                letters[low:high] = np.add.reduceat(useful.astype(np.int64), starts)
            scores /= np.maximum(letters, 1)[:, None]
            flat = pa.array(scores.reshape(-1).tolist(), pa.float64())
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * scores.shape[1], flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(letters), lists], names=["doc_id", "key", "host", "declared", "letters", "likelihoods"])

    return run


def identify_languages(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", accept: list[str] | None = None) -> DataFrame:
    """doc_id, _key, language, posterior, text_language, declared and kept of every row of docs.

    docs has doc_id, the text, the declared language (a lang column or an html lang attribute; may be null) and the
    host (its suffix is what follows its last dot). Texts without letters have no evidence of their own: language
    null, kept false. A document whose declared language has too little text for a model (MIN_CHARS) stays what it
    declares, with a null posterior: no model could say otherwise. A document is also rejected if no language has a posterior of MIN_POSTERIOR, or if accept is
    given and lacks its language. Null hosts are one host; a null declared language is no evidence. _key joins rows
    of docs: row_key(doc_id, text). Without any model every row that declares nothing is rejected.
    """
    spark = docs.sparkSession
    counted = docs.where(F.col(declared).isNotNull()).groupBy(F.col(declared).alias("lang")).agg(F.count("*").alias("count"), F.sum(F.length(text)).alias("chars"))
    listed = counted.where(F.col("chars") >= MIN_CHARS).select("lang", "count").collect()
    share = {r["lang"]: TRAIN_PER_LANGUAGE / r["count"] for r in listed}
    languages = sorted(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003
    models = F.broadcast(spark.createDataFrame([(x, k, share[x]) for k, x in enumerate(languages)], "_of string, _k int, _share double"))
    train = docs.select("doc_id", F.col(declared).alias("_of"), F.col(text).alias("_text")).join(models, "_of").where(draw < F.col("_share")).select("_k", "_text")
    grams = train.mapInArrow(_counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages)), 0.1, np.float32)
    if languages:
        fitted = grams.toPandas()  # BUCKETS rows a language at most
        table[fitted["bucket"], fitted["lang"]] += fitted["n"]
        table = np.log(table / table.sum(axis=0, dtype=np.float64)).astype(np.float32)

    rows = docs.select("doc_id", row_key("doc_id", text).alias("key"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(declared).alias("declared"), text)
    scored = rows.mapInArrow(_scored(table), "doc_id long, key string, host string, declared string, letters long, likelihoods array<double>")
    best = F.when((F.col("letters") > 0) & (F.size("likelihoods") > 0), F.array_position("likelihoods", F.array_max("likelihoods")).cast("int") - 1)
    suffix = F.substring_index("host", ".", -1)
    scored = written(scored.withColumn("best", best).withColumn("suffix", suffix))

    n = len(languages)
    by_best = written(scored.groupBy("suffix", "host", "best").agg(F.count("*").alias("n")))

    def counts_of(*by: str) -> DataFrame:
        """by, counts (a map from languages) and all, their sum."""
        sums = by_best.groupBy(*by, "best").agg(F.sum("n").alias("n"))
        seen = F.col("best").isNotNull()
        return sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(seen, F.struct("best", "n")))).alias("counts"), F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("all"))

    everywhere = {r["best"]: r["n"] for r in by_best.where("best is not null").groupBy("best").agg(F.sum("n").alias("n")).collect()}
    size = sum(everywhere.values())
    overall = F.array(*[F.lit((everywhere.get(k, 0) + 1) / (size + n)) for k in range(n)]).cast("array<double>")

    def smoothed(parents: Column, weight: float) -> Column:
        return F.transform(parents, lambda p, k: (F.coalesce(F.try_element_at("counts", k), F.lit(0)) + weight * p) / (F.col("all") + weight))

    by_suffix = counts_of("suffix").select("suffix", smoothed(overall, SUFFIX_WEIGHT).alias("above"))
    priors = counts_of("suffix", "host").join(by_suffix, "suffix").select("host", smoothed(F.col("above"), HOST_WEIGHT).alias("prior"))

    # P(declared | language): languages by (known declarations and one for all others), a table of n * (n + 1) numbers
    other = n
    told = scored.join(models.select(F.col("_of").alias("declared"), "_k"), "declared", "left")
    told = told.withColumn("said", F.when(F.col("declared").isNotNull(), F.coalesce("_k", F.lit(other))))
    pairs = told.where("best is not null and said is not null").groupBy("said", "best").count().collect()
    seen = {(r["said"], r["best"]): r["count"] for r in pairs}
    rowsum = [0] * n
    for (_, k), c in seen.items():
        rowsum[k] += c
    chance = [(x, [float(np.log((seen.get((x, k), 0) + 1) / (rowsum[k] + n + 1))) for k in range(n)]) for x in range(n + 1)]
    evidence = F.broadcast(spark.createDataFrame(chance, "said int, _said array<double>"))

    count = F.least(F.col("letters") / OVERLAP, F.lit(EVIDENCE))
    fused = told.join(priors, "host").join(evidence, "said", "left")
    fused = fused.withColumn("_logs", F.transform("likelihoods", lambda x, k: count * x + F.log(F.get("prior", k)) + F.coalesce(F.get("_said", k), F.lit(0.0))))
    top = F.array_max("_logs")
    names_of = F.array(*map(F.lit, languages)).cast("array<string>")
    has = F.col("letters") > 0
    modelled = has & (F.size("_logs") > 0)
    unmodelled = has & F.coalesce(F.col("said") == other, F.lit(False))
    posterior = 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = fused.select(
        "doc_id",
        F.col("key").alias("_key"),
        F.when(unmodelled, F.col("declared")).when(modelled, F.get(names_of, F.array_position("_logs", top).cast("int") - 1)).alias("language"),
        F.when(modelled & ~unmodelled, posterior).alias("posterior"),
        F.when(modelled, F.get(names_of, F.col("best"))).alias("text_language"),
        "declared",
        unmodelled.alias("_declared_only"),
    )
    good = F.col("_declared_only") | F.coalesce(F.col("posterior") >= MIN_POSTERIOR, F.lit(False))
    if accept is not None:
        good &= F.coalesce(F.col("language").isin(accept), F.lit(False))
    return out.withColumn("kept", good).drop("_declared_only")
