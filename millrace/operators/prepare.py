"""Cleaning, imputing, encoding, scaling, splitting. Fitting is one aggregation; applying is a projection or a join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.expressions import hash_bucket
from millrace.functions.ranks import numbered, placed, quantiles, running_sums
from millrace.sources.storage import written


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_missing, n_rows), one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["n_rows"], columns, "column_name", "n_missing").select("column_name", "n_missing", "n_rows")


def inject_missing(df: DataFrame, key: str, columns: list[str], percent: int, seed: int = 0) -> DataFrame:
    """Each cell of the columns is nulled with the given chance, by the hash of key and column number."""
    return df.withColumns({c: F.when(hash_bucket(F.col(key), seed + k, 100) >= percent, F.col(c)) for k, c in enumerate(columns)})


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """(value, n): the most frequent value, the smallest of equally frequent ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(1)


def impute(df: DataFrame, columns: list[str], how: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Nulls by the column's mean, median (exact, interpolated) or mode in fitted_on (df by default)."""
    base = df if fitted_on is None else fitted_on
    if how == "mode":
        fill = {c: r["value"] for c in columns if (r := mode_of(base, c).head()) is not None}
    elif how == "median":
        fill = {c: v for c in columns if (v := quantiles(base, c, [0.5])[0]) is not None}
    else:
        fill = {c: v for c, v in base.agg(*[{"mean": F.avg}[how](c).alias(c) for c in columns]).head().asDict().items() if v is not None}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def impute_by_draw(df: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """Nulls by a draw from the column's own distribution: the value whose cumulated share holds the key's hash.

    A million draws are told apart: in a column of more distinct values the rarest may never be drawn.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    up = running_sums(counts, [F.col("_v")], {"_high": "_n"})
    total = up.agg(F.max("_high")).head()[0] or 0
    first = lambda c: F.floor((c * 1_000_000 + (total - 1)) / F.lit(max(total, 1))).cast("long")
    # the draws, of a million, that each value has: a table of a million rows at any size
    ends = up.select("_v", first(F.col("_high") - F.col("_n")).alias("_from"), (first(F.col("_high")) - 1).alias("_to")).where("_from <= _to")
    draws = ends.select("_v", F.explode(F.sequence("_from", "_to")).alias("_d"))
    gaps = df.where(F.col(column).isNull()).withColumn("_d", hash_bucket(F.col(key), seed, 1_000_000))
    filled = gaps.join(draws, "_d").withColumn(column, F.col("_v")).select(*df.columns)
    return df.where(F.col(column).isNotNull()).unionByName(filled)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): places from 0 in sorted order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return numbered(values, [F.col("value")], "code").withColumn("code", F.col("code").cast("int"))


def encode(df: DataFrame, column: str, codes: DataFrame, out: str, unknown: int | None = None) -> DataFrame:
    """df with out: the value's code; nulls and unknown values get unknown."""
    joined = df.join(codes.withColumnsRenamed({"value": column, "code": out}), column, "left")
    return joined if unknown is None else joined.withColumn(out, F.coalesce(out, F.lit(unknown)))


def one_hot(df: DataFrame, column: str, values: list, drop_first: bool = False) -> DataFrame:
    """df with a 0/1 column for each fitted value, in order; unknown values have zeros."""
    kept = values[1:] if drop_first else values
    return df.withColumns({f"{column}_{k + drop_first}": (F.col(column) == v).cast("int") for k, v in enumerate(kept)})


def scale(df: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Columns standardised (population deviation), to [0, 1], or by median and quartile range; a zero width counts as 1."""
    stats = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
    }.get(how)
    if how == "robust":
        quartiles = {c: quantiles(df, c, [0.25, 0.5, 0.75]) for c in columns}
        return df.withColumns({c: (F.col(c) - mid) / ((high - low) or 1.0) for c, (low, mid, high) in quartiles.items() if mid is not None})
    fitted = df.agg(*[x.alias(f"{c}_{k}") for c in columns for k, x in enumerate(stats(c))]).head()
    return df.withColumns({c: (F.col(c) - fitted[f"{c}_0"]) / (fitted[f"{c}_1"] or 1.0) for c in columns if fitted[f"{c}_0"] is not None})


def within_iqr(df: DataFrame, columns: list[str], width: float = 1.5) -> DataFrame:
    """Rows within width quartile ranges of the quartiles; each column's are taken from what the ones before left."""
    for c in columns:
        low, high = quantiles(df, c, [0.25, 0.75])
        if low is not None:
            df = df.where(F.col(c).between(low - width * (high - low), high + width * (high - low)))
    return df


def split_by_hash(df: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """split: train for that share of the keys, else test."""
    return df.withColumn("split", F.when(hash_bucket(F.col(key), seed, 100) < percent, "train").otherwise("test"))


def split_within(df: DataFrame, by: list[str], key: str, share: float, seed: int = 0, rounds: str = "floor", keep: int = 0, few_groups: bool = False) -> DataFrame:
    """split within each group: test for the first share of rows in hash order; at least keep rows stay in train.

    rounds: floor; some (floor, but one at least); near (rounded half to even, one at least). A group of one column's
    value is numbered in hash ranges if few_groups says that there are few, large ones.
    """

    def wanted(n: Column) -> Column:
        if rounds == "floor":
            return F.floor(n * share)
        return F.greatest(F.lit(1), F.floor(n * share) if rounds == "some" else F.bround(n * share, 0).cast("long"))

    if few_groups:
        n, place = F.col("_size"), F.col("_place")
        df = placed(df, by[0], hash_bucket(F.col(key), seed, 1 << 31), key)
        return df.withColumn("split", F.when(place <= F.least(wanted(n), n - keep), "test").otherwise("train")).drop("_size", "_place")
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(hash_bucket(F.col(key), seed, 1 << 31), key))
    return df.withColumn("split", F.when(place <= F.least(wanted(n), n - keep), "test").otherwise("train"))


def folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """fold 0 to k - 1, dealt in turn within each label."""
    dealt = placed(df, label, hash_bucket(F.col(key), seed, 1 << 31), key)
    return dealt.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_size")


def split_by_time(df: DataFrame, time: str, key: str, share: float) -> DataFrame:
    """split: train up to the share-th row by time and key, which must not tie. Ranges of rows are numbered, so no task orders all."""
    cut = round(df.count() * share)
    return numbered(df, [F.col(time), F.col(key)], "_place").withColumn("split", F.when(F.col("_place") < cut, "train").otherwise("test")).drop("_place")


def core(df: DataFrame, user: str, item: str, least: int, passes: int = 3) -> DataFrame:
    """Rows whose user and item have least rows, by a fixed number of passes over both.

    Users and items only grow fewer, so the last list of each says what is left; a pass counts the narrow rows that both keep.
    """
    narrow, kept = written(df.select(user, item)), {}
    for _ in range(passes):
        for c in (user, item):
            rows = narrow
            for other, ids in kept.items():
                rows = rows.join(ids, other, "left_semi")
            kept[c] = written(rows.groupBy(c).agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & F.col(c).isNotNull()).select(c))
    for c, ids in kept.items():
        df = df.join(ids, c, "left_semi")
    return df


def undersample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each label as the rarest one has, by hash order."""
    rarest = df.groupBy(label).count().agg(F.min("count")).head()[0] or 0
    return placed(df, label, hash_bucket(F.col(key), seed, 1 << 31), key).where(F.col("_place") <= rarest).drop("_place", "_size")


def poisson_times(tree: Column, key: Column, seed: int = 0) -> Column:
    """How often a tree draws the row of a key, Poisson(1) by hash."""
    u = hash_bucket(F.concat_ws(":", tree, key), seed, 1_000_000) / 1_000_000
    total, times, term = 0.0, F.lit(7), 0.36787944117144233
    steps: list[tuple[float, int]] = []
    for k in range(7):
        total += term
        term /= k + 1
        steps.append((total, k))
    for most, k in reversed(steps):
        times = F.when(u < most, k).otherwise(times)
    return times.cast("int")


def bootstrap(df: DataFrame, key: str, trees: int, seed: int = 0) -> DataFrame:
    """(tree, key, times): each row drawn Poisson(1) times for each tree, by its hash: no shuffle, no row numbers."""
    each = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return each.withColumn("times", poisson_times(F.col("tree"), F.col(key), seed))


def _drawn_place(tree: Column, draw: Column, seed: int, n: int) -> Column:
    """0 to n - 1 by 60 bits of a hash, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), tree, draw)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % n


def drawn_with_replacement(df: DataFrame, key: str, trees: int, size: int | None = None, seed: int = 0) -> DataFrame:
    """(tree, key, times): for each tree, exactly size draws (by default as many as rows) among all rows; only rows that are drawn.

    Rows are numbered by key, in ranges; draws are counted by place before they meet the rows. Keys are unique.
    """
    rows = written(numbered(df.select(key), [F.col(key)], "_place"))
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).alias("tree"), key, F.lit(0).alias("times"))
    each = df.sparkSession.range(trees * (size or n)).select(F.floor(F.col("id") / (size or n)).cast("int").alias("tree"), (F.col("id") % (size or n)).alias("draw"))
    counts = each.select("tree", _drawn_place(F.col("tree"), F.col("draw"), seed, n).alias("_place")).groupBy("tree", "_place").agg(F.count("*").cast("int").alias("times"))
    return rows.join(counts, "_place").select("tree", key, "times")


def drawn_without_replacement(df: DataFrame, key: str, trees: int, size: int | float, seed: int = 0) -> DataFrame:
    """(tree, key, times = 1): for each tree, exactly size rows (below 1: that share, rounded), those of the smallest hashes."""
    each = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    hashed = hash_bucket(F.concat_ws(":", F.col("tree"), F.col(key)), seed, 1 << 31)
    most = F.round(F.col("_size") * size) if size < 1 else F.lit(size)
    return placed(each, "tree", hashed, key).where(F.col("_place") <= most).select("tree", key, F.lit(1).alias("times"))


def inject_missing_share(df: DataFrame, key: str, columns: list[str], share: float, seed: int = 0) -> DataFrame:
    """df with exactly the share (rounded down) of each column's known cells nulled, those of the smallest hashes. Keys are unique."""
    for k, c in enumerate(columns):
        known = df.where(F.col(c).isNotNull()).select(key)
        most = int(known.count() * share)
        first = numbered(known, [hash_bucket(F.col(key), seed + k, 1 << 31), F.col(key)], "_place").where(F.col("_place") < most)
        df = df.join(first.select(key, F.lit(True).alias("_gone")), key, "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
    return df


def inject_missing_cells(df: DataFrame, key: str, columns: list[str], share: float, seed: int = 0) -> DataFrame:
    """df with the cells nulled that share * rows * columns draws hit; draws may hit a cell again, so fewer may go. Keys are unique."""
    rows = written(numbered(df.select(key), [F.col(key)], "_place"))
    n = rows.count()
    draws = df.sparkSession.range(int(n * len(columns) * share)).select(_drawn_place(F.lit(0), F.col("id"), seed, max(n, 1) * len(columns)).alias("_cell")).distinct()
    hits = draws.groupBy(F.floor(F.col("_cell") / len(columns)).alias("_place")).agg(F.collect_set((F.col("_cell") % len(columns)).cast("int")).alias("_hit"))
    marked = df.join(rows.join(hits, "_place").select(key, "_hit"), key, "left")
    return marked.withColumns({c: F.when(~F.coalesce(F.array_contains("_hit", k), F.lit(False)), F.col(c)) for k, c in enumerate(columns)}).drop("_hit")


#: Terms whose weights are broadcast at most; a row has a term and a number.
BROADCAST_TERMS = 1_000_000


#: Bytes of the texts of a part, about.
DOC_BYTES = 8_000_000


def tfidf(docs: DataFrame, doc: str, text: str, min_df: int = 1, shortest: int = 2, stop: tuple[str, ...] = (), max_df: float = 1.0, most_terms: int | None = None) -> DataFrame:
    """(doc, term, weight): smooth idf, rows of unit length. Terms are runs of a-z in lower case.

    Terms in fewer than min_df documents, or in more than the share max_df of them, are left out; of the others the
    most_terms most frequent ones count, equally frequent ones by name. Texts go to their document's part before they are
    cut, so that terms are counted and weighed there and not shuffled (but for their counts, and beyond BROADCAST_TERMS).
    """
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    whole = docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text")).repartition(max(1, -(-size // DOC_BYTES)), "doc")
    terms = whole.select("doc", F.explode(F.split(F.lower("_text"), "[^a-z]+")).alias("term"))
    terms = terms.where((F.length("term") >= shortest) & ~F.col("term").isin(*stop)) if stop else terms.where(F.length("term") >= shortest)
    tf = terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    n = docs.select(F.countDistinct(doc)).head()[0]
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if most_terms is not None:
        df = df.orderBy(F.desc("all"), "term").limit(most_terms)
    idf = written(df.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    idf = F.broadcast(idf) if idf.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else idf
    raw = tf.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("x"))
    return raw.select("doc", "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc")))).alias("weight"))


def split_three_ways(df: DataFrame, label: str, key: str, train: float = 0.6, validation: float = 0.2, seed: int = 0) -> DataFrame:
    """split: train, validation or test by hash order within each label; what rounding leaves over is test."""
    n, place = F.col("_size"), F.col("_place")
    dealt = placed(df, label, hash_bucket(F.col(key), seed, 1 << 31), key)
    first, second = F.floor(n * train), F.floor(n * train) + F.floor(n * validation)
    return dealt.withColumn("split", F.when(place <= first, "train").when(place <= second, "validation").otherwise("test")).drop("_size", "_place")


def with_least(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows whose value of every column has least rows, counted in the table as it came."""
    out = df
    for c in columns:
        out = out.join(df.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(c), c, "left_semi")
    return out


def unit_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their Euclidean norms; a column of zeros stays."""
    norms = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns]).head()
    return df.withColumns({c: F.col(c) / F.lit(norms[c] or 1.0) for c in columns})


def codes_by_appearance(df: DataFrame, column: str, order: str, out: str = "code") -> DataFrame:
    """(column, out): 0, 1, ... by a value's first appearance in that order; nulls have no code."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    return numbered(first, [F.col("_first"), F.col(column)], out).drop("_first")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each distinct combination of keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_p", place).where("_p = 1").drop("_p")


def beside(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of two tables side by side by their places; the longer one's last rows have nulls. Columns must differ."""
    return numbered(left, left_order, "_at").join(numbered(right, right_order, "_at"), "_at", "full_outer").drop("_at")


def plain_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, in lower case, with _ for runs of other signs than letters and digits."""
    return df.toDF(*[re.sub(r"[^0-9a-z]+", "_", c.strip().lower()).strip("_") for c in df.columns])


def checked_labels(df: DataFrame, label: str, allowed: list) -> DataFrame:
    """df as it is; an error if a label is null or not allowed."""
    wrong = df.where(F.col(label).isNull() | ~F.col(label).isin(allowed)).select(label).limit(1).collect()
    if wrong:
        raise ValueError(f"label {wrong[0][0]!r} is not one of {allowed}")
    return df
