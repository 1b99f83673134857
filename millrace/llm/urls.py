"""URL filters: rules, and for the rest the ratio of two variable-order character models. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, maybe_broadcast, row_key, written

#: (verdict, host, path): the rules of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of context at most.
ORDER = 4
_START = "\x02" * ORDER


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ? or # (A-Z lower-cased), and from there up to ? or #; both empty without ://."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _positions(urls: DataFrame, keep: list[str]) -> DataFrame:
    """keep, char (each character of url and its end) and c0 to c4: the 0 to 4 characters before it.

    A url is split into characters once and what is kept should be short, so a long one costs in proportion to its length.
    """
    chars = F.split(F.concat(F.lit(_START), F.col("url"), F.lit("\x03")), "")

    def window(i: Column) -> Column:
        before = [F.concat(F.lit(""), *[F.get("_chars", i - j) for j in range(k, 0, -1)]).alias(f"c{k}") for k in range(ORDER + 1)]
        return F.struct(F.get("_chars", i).alias("char"), *before)

    each = urls.select(*keep, chars.alias("_chars"))
    return each.select(*keep, F.explode(F.transform(F.sequence(F.lit(ORDER), F.size("_chars") - 1), window)).alias("_w")).select(*keep, "_w.*")


def _models(training: DataFrame) -> DataFrame:
    """(context, escape, known): log-likelihoods in the accepted class minus those in the rejected one.

    Witten-Bell smoothing in either class: p(c | context) = (n + t * p(c | shorter context)) / (N + t), with N
    occurrences and t different continuations of the context, down to 1 / 256. known has the difference of each
    character seen after the context; for others escape, that of t / (N + t), is added to what the shorter context gives.
    """
    each = _positions(training, ["accepted"]).select("accepted", "char", F.explode(F.array(*[F.col(f"c{k}") for k in range(ORDER + 1)])).alias("context"))
    counts = written(each.groupBy("context", "char").agg(F.sum(F.col("accepted").cast("long")).alias("n1"), F.sum((~F.col("accepted")).cast("long")).alias("n0")))
    totals = counts.groupBy("context").agg(*[F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0).alias(f"t{c}") for c in (0, 1)])
    joined = written(counts.join(totals, "context").withColumn("shorter", F.expr("substring(context, 2)")))

    def seen(c: int, then: Column, other: Column) -> Column:
        return F.when(F.col(f"all{c}") > 0, then / (F.col(f"all{c}") + F.col(f"t{c}"))).otherwise(other)

    out, below = None, None
    for size in range(ORDER + 1):
        level = joined.where(F.length("context") == size)
        if below is None:
            level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            level = level.join(below.select(F.col("context").alias("shorter"), "char", F.col("p0").alias("q0"), F.col("p1").alias("q1")), ["shorter", "char"])
        p = {f"p{c}": seen(c, F.col(f"n{c}") + F.col(f"t{c}") * F.col(f"q{c}"), F.col(f"q{c}")) for c in (0, 1)}
        escape = F.log(seen(1, F.col("t1"), F.lit(1.0))) - F.log(seen(0, F.col("t0"), F.lit(1.0)))
        below = written(level.withColumns(p).select("context", "char", "p0", "p1", escape.alias("escape")))
        out = below if out is None else out.unionByName(below)
    pairs = F.collect_list(F.struct("char", (F.log("p1") - F.log("p0")).alias("d")))
    return written(out.groupBy("context").agg(F.first("escape").alias("escape"), F.map_from_entries(pairs).alias("known")))


def _scores(urls: DataFrame, keep: list[str], model: DataFrame) -> DataFrame:
    """keep (with url), score (mean log-likelihood difference of the url's characters) and copies (equal rows).

    Each url is scored once, under a number of 128 bits, whatever its rows.
    """
    rows = written(urls.groupBy(*keep).agg(F.count("*").cast("int").alias("copies")).withColumn("_key", row_key("url")))
    each, d = _positions(rows.select("_key", "url").dropDuplicates(["_key"]), ["_key"]), F.lit(0.0)
    for k in range(ORDER + 1):
        part = model.where(F.length("context") == k).select(F.col("context").alias(f"c{k}"), F.col("escape").alias(f"e{k}"), F.col("known").alias(f"m{k}"))
        each = each.join(maybe_broadcast(part) if k else F.broadcast(part), f"c{k}", "left")  # a row for the empty context
        d = F.coalesce(F.try_element_at(F.col(f"m{k}"), F.col("char")), F.coalesce(f"e{k}", F.lit(0.0)) + d)
    return rows.join(each.groupBy("_key").agg(F.avg(d).alias("score")), "_key").select(*keep, "score", "copies")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url; others are ignored).

    All URLs that rules decide fit the two models or, one in five that are kept apart, calibrate the threshold: the point between the class means, by their deviations. The rest is
    allowed if its score reaches the threshold; everything is allowed if one class is missing. Null and empty urls
    have empty host and path and are scored by their end alone. Repeated rows give repeated rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    ruled = rows.where(F.col("rule").isNotNull())
    counts = {r["verdict"]: r["count"] for r in ruled.groupBy("verdict").count().collect()}
    decided = ruled.select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    open_rows = rows.where(F.col("rule").isNull())
    if not counts.get("allow") or not counts.get("block"):
        return decided.unionByName(open_rows.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("score")))
    labelled = ruled.select("page_id", "url", (F.col("verdict") == "allow").alias("accepted"), (F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0).alias("_apart"))
    labelled = written(labelled)
    model = _models(labelled.where("not _apart"))
    seen = _scores(labelled.where("_apart"), ["page_id", "url", "accepted"], model)
    stats = {r["accepted"]: r for r in seen.groupBy("accepted").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev")).collect()}
    if True in stats and False in stats:
        a, b = stats[True], stats[False]
        wide = a["dev"] + b["dev"]
        threshold = (a["mean"] * b["dev"] + b["mean"] * a["dev"]) / wide if wide else (a["mean"] + b["mean"]) / 2
    else:
        threshold = 0.0
    scored = _scores(open_rows, ["page_id", "url", "host", "path"], model).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    judged = scored.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    return decided.unionByName(judged)
