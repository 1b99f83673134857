"""Quality rules: counts within a text, and line frequency across the documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, maybe_broadcast, row_key, shingle_hashes, words, written

#: A line in more documents of one host than this is frequent; a document needs this share of its characters besides.
MAX_DOCUMENTS, MIN_LEFT = 10, 0.5
SYMBOLS = "#*$%&|<>"
REPEATED, SALTS = 8, 16


def _covered(hashes: Column) -> Column:
    """Words in windows of REPEATED words whose hash occurs twice or more; hashes: of all windows, in order."""

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda e, i: F.coalesce(F.when(i > 0, F.get(s, i - 1).h == e.h), F.lit(False)) | F.coalesce(F.get(s, i + 1).h == e.h, F.lit(False))),
                    lambda e: e.p,
                )
            ),
        )
        # positions in order: each window adds what the next one doesn't cover
        gaps = let(twice, lambda q: F.transform(q, lambda p, i: F.least(F.lit(REPEATED), F.coalesce(F.get(q, i + 1) - p, F.lit(REPEATED)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(counted(h)))


def _within(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, as a struct."""
    plain = text
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.octet_length(text) - F.octet_length(plain)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _covered(shingle_hashes(w, REPEATED)).alias("n_repeat_words"),
        ),
    )


def _lines(docs: DataFrame, text: Column) -> DataFrame:
    """_key, _host, line (hash of the lower-cased, trimmed line) and chars of each line that is not blank."""
    each = docs.select(row_key("doc_id", "source", "text").alias("_key"), F.coalesce("source", F.lit("")).alias("_host"), F.explode(F.split(text, "\n")).alias("l"))
    each = each.withColumn("l", F.btrim("l", F.lit(SPACE_CHARS))).where("l <> ''")
    return each.select("_key", "_host", F.xxhash64(F.lower("l")).alias("line"), F.length("l").alias("chars"))


def frequent_lines(docs: DataFrame, most: int = MAX_DOCUMENTS) -> DataFrame:
    """(_host, line, n_docs): lines in more than most distinct documents of a host.

    Rows that repeat a document (doc_id, source and text) count once: each counts its share. Counts are added up before
    the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.array_distinct(F.transform(F.split(F.lower(text), "\n"), lambda x: F.when(F.btrim(x, F.lit(SPACE_CHARS)) != "", F.xxhash64(F.btrim(x, F.lit(SPACE_CHARS))))))
    keyed = docs.select(row_key("doc_id", "source", "text").alias("_key"), F.coalesce("source", F.lit("")).alias("_host"), hashes.alias("lines"))
    again = written(docs.groupBy(row_key("doc_id", "source", "text").alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1"))
    if again.limit(1).count():
        keyed = keyed.join(maybe_broadcast(again), "_key", "left")
    else:
        keyed = keyed.withColumn("_rows", F.lit(None).cast("long"))
    each = keyed.select("_host", "_rows", F.explode("lines").alias("line")).where("line is not null")
    single, shared = F.count(F.when(F.col("_rows").isNull(), 1)), F.sum(F.when(F.col("_rows").isNotNull(), 1 / F.col("_rows")))
    n_docs = (single + F.coalesce(F.round(shared), F.lit(0.0))).cast("long")
    return written(each.groupBy("_host", "line").agg(n_docs.alias("n_docs")).where(F.col("n_docs") > most))


def judge(docs: DataFrame, most: int = MAX_DOCUMENTS, least: float = MIN_LEFT) -> DataFrame:
    """The counts, base_failed, left (share of characters outside frequent lines) and kept of every row of docs.

    docs has doc_id, text and source (the host; null is a host of its own with ''). Null and blank texts have zero
    counts and fail the base rule. Equal rows have equal results. A document is kept if the base rule does not fail
    and at least the share least of its characters is left when the frequent lines of its host are removed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key("doc_id", "source", "text").alias("_key"), _within(text).alias("m"))
    rows = rows.select("doc_id", "_key", "m.*")
    bad = frequent_lines(docs, most)
    lines = _lines(docs, text)
    hinted = maybe_broadcast(bad)
    if hinted is bad:  # too many to broadcast: a frequent line's rows go to SALTS tasks
        bad = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        removed = lines.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(bad, ["_host", "line", "_salt"], "left")
    else:
        removed = lines.join(hinted, ["_host", "line"], "left")
    shares = removed.groupBy("_key").agg((1 - F.sum(F.when(F.col("n_docs").isNotNull(), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("left"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.coalesce("left", F.lit(1.0))
    out = rows.join(shares, "_key", "left").withColumns({"base_failed": failed, "left": left}).withColumn("kept", ~failed & (left >= least))
    return out.drop("_key")


def without_frequent_lines(docs: DataFrame, most: int = MAX_DOCUMENTS) -> DataFrame:
    """docs with the frequent lines of each host removed from text. Line order and all columns stay."""
    bad = frequent_lines(docs, most)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_key", row_key("doc_id", "source", "text"))
    each = base.select("_key", F.coalesce("source", F.lit("")).alias("_host"), F.posexplode(F.split(text, "\n")).alias("at", "l"))
    each = each.dropDuplicates(["_key", "at"]).withColumn("line", F.xxhash64(F.lower(F.btrim("l", F.lit(SPACE_CHARS)))))
    kept = each.join(maybe_broadcast(bad), ["_host", "line"], "left_anti").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", "l"))).alias("ls"))
    fresh = kept.select("_key", F.array_join(F.transform("ls", lambda x: x.l), "\n").alias("_text"))
    return base.join(fresh, "_key", "left").withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce("_text", F.lit("")))).drop("_key", "_text")
