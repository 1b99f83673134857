"""Quality of classifiers, regressions, clusterings and rankings, each by aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.ranks import running_sums
from millrace.sources.storage import written


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))


def _by_class(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """hits, n_real, p, r and f of each class. An undefined ratio counts as 0."""
    cells = confusion(df, y, yhat)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    real = cells.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("n_real"), F.sum(hit).alias("hits"))
    said = cells.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("n_said"))
    each = real.join(said, "c", "full_outer").na.fill(0, ["n_real", "hits", "n_said"])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("hits"), F.col("n_said")), safe(F.col("hits"), F.col("n_real"))
    return each.select("hits", "n_real", p.alias("p"), r.alias("r")).withColumn("f", safe(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def classification(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: accuracy and macro precision, recall, f1. An undefined ratio counts as 0."""
    each = _by_class(df, y, yhat)
    return each.agg((F.sum("hits") / F.sum("n_real")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def classification_weighted(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: precision, recall and f1 weighted by the classes' rows, and balanced accuracy (mean recall of real classes)."""
    mean = lambda c: F.sum(F.col(c) * F.col("n_real")) / F.sum("n_real")
    balanced = F.avg(F.when(F.col("n_real") > 0, F.col("r")))
    return _by_class(df, y, yhat).agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), balanced.alias("balanced_accuracy"))


def best_f1(df: DataFrame, y: str, score: str) -> DataFrame:
    """threshold and f1 of the score from which positives are predicted best; of equal ones the highest threshold."""
    curve = roc(df, y, score)
    positives = df.agg(F.sum(y)).head()[0] or 0
    return curve.select(F.col("score").alias("threshold"), (2 * F.col("tp") / (F.col("tp") + F.col("fp") + positives)).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def hard_vote(votes: list[Column]) -> Column:
    """The most frequent of a row's votes; of equal ones the smallest. Nulls don't vote."""
    given = F.array_compact(F.array(*votes))
    counted = F.transform(F.array_distinct(given), lambda v: F.struct((-F.size(F.filter(given, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(counted)["v"]


def over_folds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean and deviation (n - 1) of a value over the folds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def outer_rmse(ranked: DataFrame, held: DataFrame, user: str, item: str, score: str, rating: str, default: float = 0.0) -> DataFrame:
    """rmse over all pairs that are ranked or held out; what one side lacks counts as default."""
    both = ranked.select(user, item, F.col(score).alias("_s")).join(held.select(user, item, F.col(rating).alias("_r")), [user, item], "full_outer")
    off = F.coalesce("_s", F.lit(default)) - F.coalesce("_r", F.lit(default))
    return both.agg(F.sqrt(F.avg(off * off)).alias("rmse"))


def _curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, p, n, tp, fp): positives and negatives at each score, and at or above it."""
    points = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("n"))
    return running_sums(points, [F.desc("score")], {"tp": "p", "fp": "n"})


def roc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, tp, fp): counts at or above each score. Equal scores are one point."""
    return _curve(df, y, score).select("score", "tp", "fp")


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(auc): trapezes under the curve; null if one class is missing."""
    step = _curve(df, y, score).select((F.col("n") * (2 * F.col("tp") - F.col("p"))).alias("area"), "tp", "fp")
    return step.agg((F.sum("area") / F.nullif(2 * F.max("tp") * F.max("fp"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    step = _curve(df, y, score).select((F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("x"), "tp")
    return step.agg((F.sum("x") / F.nullif(F.max("tp"), F.lit(0))).alias("average_precision"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return df.agg((-F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def regression(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """rmse, mae and r2 (null if y does not vary)."""
    e = F.col(y) - F.col(yhat)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"))


def clustering(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """ari and nmi (arithmetic mean) from the table of label and cluster counts."""
    cells = df.groupBy(F.col(label).alias("a"), F.col(cluster).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(pairs("n")).alias("s"))
    both = cells.join(rows, "a").join(cols, "b").crossJoin(total.select("t"))  # total is one row
    mi = both.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"))
    ha = rows.crossJoin(total).agg(F.sum(pairs("ra")).alias("sa"), (-F.sum(F.col("ra") / F.col("t") * F.log(F.col("ra") / F.col("t")))).alias("ha"))
    hb = cols.crossJoin(total).agg(F.sum(pairs("cb")).alias("sb"), (-F.sum(F.col("cb") / F.col("t") * F.log(F.col("cb") / F.col("t")))).alias("hb"))
    one = total.crossJoin(mi).crossJoin(ha).crossJoin(hb)
    expected = F.col("sa") * F.col("sb") / pairs("t")
    top, mean = (F.col("sa") + F.col("sb")) / 2 - expected, (F.col("ha") + F.col("hb")) / 2
    return one.select(F.when(top == 0, 1.0).otherwise((F.col("s") - expected) / top).alias("ari"), F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))


def assignment(value: np.ndarray) -> list[int]:
    """For each row of a matrix, no wider than high, a column of its own with the largest sum; -1 for rows left over.

    Shortest augmenting paths, a column at a time: the cube of the size, vectorised over one side.
    """
    value = np.asarray(value, float)
    cost = (value.max(initial=0.0) - value).T  # columns are placed one by one
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, here, shift = i, -1, 0.0
        while True:
            reach = shift + cost[at] - u[at] - v
            better = ~done & (reach < least)
            least[better], came[better] = reach[better], here
            here = int(np.where(done, np.inf, least).argmin())
            shift, done[here] = least[here], True
            if owner[here] < 0:
                break
            at = owner[here]
        seen = done.copy()
        seen[here] = False
        u[owner[seen]] += shift - least[seen]
        u[i] += shift
        v[seen] -= shift - least[seen]
        while here >= 0:
            before = came[here]
            owner[here] = owner[before] if before >= 0 else i
            here = before
    return owner.tolist()


def cluster_accuracy(df: DataFrame, label: str, cluster: str) -> float:
    """Share of rows in agreement under the best one-to-one matching of labels and clusters; rows with a null don't count.

    Spark counts the cells; the driver holds labels times clusters numbers. A table without rows is an error.
    """
    cells = df.where(F.col(label).isNotNull() & F.col(cluster).isNotNull()).groupBy(F.col(label).alias("a"), F.col(cluster).alias("b")).agg(F.count("*").alias("n")).collect()
    if not cells:
        raise ValueError("no rows")
    a, b = ({x: k for k, x in enumerate(sorted({r[c] for r in cells}))} for c in ("a", "b"))
    counts = np.zeros((len(a), len(b)))
    for r in cells:
        counts[a[r.a], b[r.b]] = r.n
    counts = counts if len(a) >= len(b) else counts.T
    return float(sum(counts[k, c] for k, c in enumerate(assignment(counts)) if c >= 0) / sum(r.n for r in cells))


def silhouette(points: DataFrame, vector: str, cluster: str) -> DataFrame:
    """points with a, b and silhouette, by squared distances: means over a cluster follow from its count, sum and square sum.

    A point alone in its cluster has 0; with one cluster all are null. A row a cluster comes to each task. Vectors have
    no nulls, and rows without a cluster are left out.
    """
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    rows = points.where(F.col(cluster).isNotNull()).withColumn("_x", x)
    square = F.aggregate(F.transform("_x", lambda e: e * e), F.lit(0.0), lambda s, e: s + e)
    rows = rows.withColumn("_q", square)
    cells = rows.select(F.col(cluster).alias("_c"), F.posexplode("_x").alias("_k", "_e")).groupBy("_c", "_k").agg(F.sum("_e").alias("_s"))
    sums = cells.groupBy("_c").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_s"))), lambda s: s["_s"]).alias("_sum"))
    stats = rows.groupBy(F.col(cluster).alias("_c")).agg(F.count("*").alias("_n"), F.sum("_q").alias("_qs")).join(sums, "_c")
    table = stats.agg(F.collect_list(F.struct("_c", "_n", "_qs", "_sum")).alias("_all"))  # a row a cluster
    both = rows.crossJoin(F.broadcast(table))
    cross = lambda t: F.aggregate(F.zip_with("_x", t["_sum"], lambda p, s: p * s), F.lit(0.0), lambda s, e: s + e)
    total = lambda t: t["_n"] * F.col("_q") + t["_qs"] - 2 * cross(t)  # noqa: E731  of squared distances to a cluster's points
    own = F.get(F.transform(F.filter("_all", lambda t: t["_c"] == F.col(cluster)), lambda t: F.when(t["_n"] > 1, total(t) / (t["_n"] - 1))), F.lit(0))
    other = F.array_min(F.transform(F.filter("_all", lambda t: t["_c"] != F.col(cluster)), lambda t: total(t) / t["_n"]))
    out = both.withColumns({"a": own, "b": other}).drop("_x", "_q", "_all")
    score = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return out.withColumn("silhouette", F.when(F.col("b").isNotNull(), F.coalesce(score, F.lit(0.0))))


#: Points of a block whose plain distances one task computes, and of a block of a small table.
BLOCK, SMALL_BLOCK = 16_384, 2048


def _distances(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of distances, by cluster, of the points of either block to those of the other one, or within the block."""
    left, right = (pdf[pdf["block"] == b] for b in key)
    out = [pd.DataFrame({"key": np.array([], np.int64), "to": np.array([], np.int64), "total": np.array([], np.float64)})]
    if left.empty or right.empty:
        return out[0]
    x, y = np.array(left["x"].tolist(), float), np.array(right["x"].tolist(), float)
    square = (y**2).sum(1)[None]
    ones = [pd.get_dummies(side["c"], dtype=float) for side in (left, right)]
    there, back = np.zeros((len(x), ones[1].shape[1])), np.zeros((len(y), ones[0].shape[1]))
    for low in range(0, len(x), 256):
        some = x[low : low + 256]
        d = np.sqrt(((some[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)) if x.shape[1] <= 8 else np.sqrt(np.maximum((some**2).sum(1)[:, None] + square - 2 * some @ y.T, 0))
        there[low : low + 256] = d @ ones[1].to_numpy()
        if key[0] != key[1]:
            back += d.T @ ones[0].to_numpy()[low : low + 256]
    for side, to, total in ((left, ones[1].columns, there), (right, ones[0].columns, back))[: 1 if key[0] == key[1] else 2]:
        out.append(pd.DataFrame({"key": np.repeat(side["key"].to_numpy(), len(to)), "to": np.tile(to.to_numpy(), len(side)), "total": total.ravel()}))
    return pd.concat(out)


def plain_silhouette(points: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(key, silhouette) by plain distances, of every pair of points: the time is the square of their number.

    Each pair of blocks of points meets once, in one task, so points are shuffled once for each of few large blocks.

    As silhouette() else; keys are unique longs, clusters longs.
    """
    rows = points.where(F.col(cluster).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("x"), F.col(cluster).cast("long").alias("c"))
    rows = written(rows)
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(8, -(-n // SMALL_BLOCK)))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.select(F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "key", "x", "c")
    sums = pairs.groupBy("i", "j").applyInPandas(_distances, "key long, to long, total double").groupBy("key", "to").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col("c").alias("to")).agg(F.count("*").alias("n"))
    means = sums.join(F.broadcast(sizes), "to").join(rows.select("key", "c"), "key")  # a row a cluster
    mine = F.col("to") == F.col("c")
    each = means.groupBy("key").agg(F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return each.select("key", F.when(F.col("b").isNotNull(), score).alias("silhouette"))


def top_k(scores: DataFrame, user: str, item: str, score: str, k: int) -> DataFrame:
    """The k best of each user with rank from 1; equal scores by item. Spark drops the others before the shuffle."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(score), item))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def ranking(ranked: DataFrame, held: DataFrame, user: str, item: str, gain: str, k: int, exponential: bool = False) -> DataFrame:
    """precision, recall and ndcg at k, means over the users of held (user, item, gain). ranked has rank."""
    g: Column = F.pow(F.lit(2.0), F.col(gain)) - 1 if exponential else F.col(gain).cast("double")
    held = held.select(user, item, g.alias("_g"))
    ideal = held.withColumn("_p", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("_g"), item)))
    ideal = ideal.groupBy(user).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_p") <= k, F.col("_g") / F.log2(F.col("_p") + 1)).otherwise(0.0)).alias("_ideal"))
    found = ranked.where(F.col("rank") <= k).join(held, [user, item]).groupBy(user).agg(F.count("*").alias("_hits"), F.sum(F.col("_g") / F.log2(F.col("rank") + 1)).alias("_dcg"))
    each = ideal.join(found, user, "left").na.fill(0, ["_hits", "_dcg"])
    return each.agg(F.avg(F.col("_hits") / k).alias("precision"), F.avg(F.col("_hits") / F.col("_n")).alias("recall"), F.avg(F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0)).alias("ndcg"))


def retrieved_ndcg(ranked: DataFrame, held: DataFrame, user: str, item: str, gain: str, k: int, exponential: bool = False, only_hits: bool = False) -> DataFrame:
    """(ndcg): as ranking(), but the ideal order is that of what was found, so it judges the order alone.

    Users without a hit count 0, or with only_hits not at all.
    """
    g: Column = F.pow(F.lit(2.0), F.col(gain)) - 1 if exponential else F.col(gain).cast("double")
    hits = ranked.where(F.col("rank") <= k).join(held.select(user, item, g.alias("_g")), [user, item])
    order = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("_g"), item))
    each = hits.withColumn("_p", order).groupBy(user).agg(F.sum(F.col("_g") / F.log2(F.col("rank") + 1)).alias("_dcg"), F.sum(F.col("_g") / F.log2(F.col("_p") + 1)).alias("_ideal"))
    each = held.select(user).distinct().join(each, user, "inner" if only_hits else "left")
    return each.agg(F.avg(F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0)).alias("ndcg"))


def centred_ndcg(ranked: DataFrame, held: DataFrame, user: str, item: str, rating: str, k: int) -> DataFrame:
    """(ndcg) with exponential gains of ratings in [0, 1] by the least and largest, less the user's mean, plus one; an ideal of 0 counts as 1.

    The ideal has a user's held-out items by gain, k of them at most.
    """
    low, high = held.agg(F.min(rating), F.max(rating)).head()
    wide = (high - low) or 1.0 if low is not None else 1.0
    scaled = held.select(user, item, ((F.col(rating) - F.lit(low)) / F.lit(wide)).alias("_r"))
    gains = scaled.withColumn("_g", F.pow(F.lit(2.0), F.col("_r") - F.avg("_r").over(Window.partitionBy(user)) + 1) - 1)
    both = gains.join(ranked.where(F.col("rank") <= k).select(user, item, "rank"), [user, item], "left")
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("_g"), item))
    part = lambda p: F.sum(F.when(p <= k, F.col("_g") / F.log2(p + 1)).otherwise(0.0))
    each = both.withColumn("_p", place).groupBy(user).agg(F.coalesce(part(F.col("rank")), F.lit(0.0)).alias("_dcg"), part(F.col("_p")).alias("_ideal"))
    return each.agg(F.avg(F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(1.0)).alias("ndcg"))
