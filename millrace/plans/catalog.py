"""The registered queries of the library and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.expressions import clip, hash_bucket, mapped, ratio, sigmoid
from millrace.functions.ranks import quantiles
from millrace.operators import ensembles, metrics, mixture, prepare, recommend, trees
from millrace.sources.readers import load_table
from millrace.sources.storage import written

from . import tree_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Registers f(table's DataFrame) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(load_table(spark, folder, table))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def bucket(seed: int, key: str, buckets: int) -> str:
    """hash_bucket in DuckDB's SQL."""
    return f"(('0x' || substr(md5('{seed}:' || ({key})::varchar), 1, 8))::bigint % {buckets})"


def r6(x, name: str):
    return F.round(x, 6).alias(name)


# cleaning and projections


@query("orders", "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS int) AS level, try_cast(o_orderstatus AS int) AS bad FROM orders")
def clean_cast_coerce(df):
    return df.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"), F.col("o_orderstatus").try_cast("int").alias("bad"))


@query("orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS code FROM orders")
def map_unmapped_null(df):
    return df.select("o_orderkey", mapped(F.col("o_orderstatus"), {"F": 1, "O": 0}).cast("int").alias("code"))


@query("orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def replace_keep(df):
    return df.replace({"F": "done"}, subset=["o_orderstatus"]).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("customer", "SELECT c_custkey, greatest(0.0, least(5000.0, c_acctbal)) AS bal FROM customer")
def clip_values(df):
    return df.select("c_custkey", clip(F.col("c_acctbal"), 0.0, 5000.0).alias("bal"))


@query("part", "SELECT p_partkey, round(p_retailprice / CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END, 6) AS per_size FROM part")
def derive_ratio_guarded(df):
    return df.select("p_partkey", r6(ratio(F.col("p_retailprice"), F.col("p_size") % 5), "per_size"))


@query("part", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, upper(substr(p_type, 1, 1)) AS first FROM part")
def regex_extract_title(df):
    return df.select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.upper(F.substring("p_type", 1, 1)).alias("first"))


@query("lineitem", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS dev_samp, round(stddev_pop(l_quantity), 6) AS dev_pop, round(median(l_quantity), 6) AS mid FROM lineitem GROUP BY 1")
def group_summary(df):
    q = F.col("l_quantity")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(q), "mean"), r6(F.stddev_samp(q), "dev_samp"), r6(F.stddev_pop(q), "dev_pop"), r6(F.percentile(q, F.lit(0.5)), "mid"))


@query("orders", "SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_counts(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("events", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_sums(df):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return df.select("user_id", "event_id", F.row_number().over(w).alias("place"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


# missing values

_HOLES = f"SELECT o_orderkey, o_custkey, CASE WHEN {bucket(0, 'o_orderkey', 100)} >= 10 THEN o_totalprice END AS o_totalprice, CASE WHEN {bucket(1, 'o_orderkey', 100)} >= 10 THEN o_orderpriority END AS o_orderpriority FROM orders"


def with_holes(df):
    return prepare.inject_missing(df.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderkey", ["o_totalprice", "o_orderpriority"], 10)


@query("orders", _HOLES)
def inject_missing_hash(df):
    return with_holes(df)


@query("orders", f"WITH h AS ({_HOLES}) SELECT c AS column_name, m AS n_missing, n AS n_rows FROM (SELECT 'o_totalprice' AS c, count(*) FILTER (o_totalprice IS NULL) AS m, count(*) AS n FROM h UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), count(*) FROM h)")
def missing_summary(df):
    return prepare.missing_summary(with_holes(df), ["o_totalprice", "o_orderpriority"])


@query("orders", f"WITH h AS ({_HOLES}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM h)), 6) AS price FROM h")
def impute_median(df):
    return prepare.impute(with_holes(df), ["o_totalprice"], "median").select("o_orderkey", r6(F.col("o_totalprice"), "price"))


@query("orders", f"WITH h AS ({_HOLES}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM h)), 4) AS price FROM h")
def impute_mean(df):
    return prepare.impute(with_holes(df), ["o_totalprice"], "mean").select("o_orderkey", F.round("o_totalprice", 4).alias("price"))


@query("orders", f"WITH h AS ({_HOLES}) SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM h")
def impute_mode(df):
    return prepare.impute(with_holes(df), ["o_orderpriority"], "mode").select("o_orderkey", F.col("o_orderpriority").alias("priority"))


@query("orders", f"WITH h AS ({_HOLES}), c AS (SELECT o_orderpriority AS v, count(*) AS n FROM h WHERE o_orderpriority IS NOT NULL GROUP BY 1), s AS (SELECT v, sum(n) OVER (ORDER BY v) - n AS low, sum(n) OVER (ORDER BY v) AS high, sum(n) OVER () AS t FROM c) SELECT o_orderkey, o_orderpriority AS priority FROM h WHERE o_orderpriority IS NOT NULL UNION ALL SELECT o_orderkey, v FROM h JOIN s ON {bucket(0, 'o_orderkey', 1000000)} * t >= low * 1000000 AND {bucket(0, 'o_orderkey', 1000000)} * t < high * 1000000 WHERE o_orderpriority IS NULL")
def impute_marginal_draw(df):
    return prepare.impute_by_draw(with_holes(df), "o_orderpriority", "o_orderkey").select("o_orderkey", F.col("o_orderpriority").alias("priority"))


# encoders and scalers


@query("part", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::int AS code FROM part")
def label_encode(df):
    return prepare.encode(df.select("p_partkey", "p_brand"), "p_brand", prepare.label_codes(df, "p_brand"), "code").select("p_partkey", "code")


@query("part", "WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#4')) SELECT p_partkey, coalesce(code, -1)::int AS code FROM part LEFT JOIN c USING (p_brand)")
def ordinal_unknown(df):
    fitted = prepare.label_codes(df.where("p_partkey % 2 = 0 and p_brand < 'Brand#4'"), "p_brand")
    return prepare.encode(df.select("p_partkey", "p_brand"), "p_brand", fitted, "code", -1).select("p_partkey", "code")


_STATUS = ["F", "O", "P"]


@query("orders", "SELECT o_orderkey, (o_orderstatus = 'F')::int AS o_orderstatus_0, (o_orderstatus = 'O')::int AS o_orderstatus_1, (o_orderstatus = 'P')::int AS o_orderstatus_2 FROM orders")
def one_hot(df):
    return prepare.one_hot(df.select("o_orderkey", "o_orderstatus"), "o_orderstatus", _STATUS).drop("o_orderstatus")


@query("orders", "SELECT o_orderkey, (o_orderstatus = 'O')::int AS o_orderstatus_1, (o_orderstatus = 'P')::int AS o_orderstatus_2 FROM orders")
def one_hot_drop_first(df):
    return prepare.one_hot(df.select("o_orderkey", "o_orderstatus"), "o_orderstatus", _STATUS, True).drop("o_orderstatus")


@query("customer", "SELECT c_custkey, (c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.5) FROM customer))::int AS low FROM customer")
def binarize_median(df):
    mid = df.agg(F.percentile("c_acctbal", F.lit(0.5))).head()[0]
    return df.select("c_custkey", (F.col("c_acctbal") <= F.lit(mid)).cast("int").alias("low"))


def _scaled(how):
    def f(df):
        return prepare.scale(df.select("o_orderkey", "o_totalprice"), ["o_totalprice"], how).select("o_orderkey", r6(F.col("o_totalprice"), "x"))

    f.__name__ = f"scale_{how}"
    return f


_STATS = {"standard": ("avg(o_totalprice)", "stddev_pop(o_totalprice)"), "minmax": ("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"), "robust": ("quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)")}
for _how, (_a, _b) in _STATS.items():
    query("orders", f"WITH s AS (SELECT {_a} AS a, {_b} AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / b, 6) AS x FROM orders, s")(_scaled(_how))


@query("orders", "WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, o_totalprice FROM orders, s WHERE o_totalprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)")
def iqr_filter(df):
    return prepare.within_iqr(df, ["o_totalprice"], 0.5).select("o_orderkey", "o_totalprice")


# splits and interaction filters


@query("orders", f"SELECT o_orderkey, CASE WHEN {bucket(3, 'o_orderkey', 100)} < 70 THEN 'train' ELSE 'test' END AS split FROM orders")
def split_hash(df):
    return prepare.split_by_hash(df, "o_orderkey", 70, 3).select("o_orderkey", "split")


@query("orders", f"SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {bucket(0, 'o_orderkey', 1 << 31)}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.25) THEN 'test' ELSE 'train' END AS split FROM orders")
def split_stratified(df):
    return prepare.split_within(df, ["o_orderstatus"], "o_orderkey", 0.25, few_groups=True).select("o_orderkey", "split")


@query("events", f"SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {bucket(0, 'event_id', 1 << 31)}, event_id) <= least(greatest(1, floor(count(*) OVER (PARTITION BY user_id) * 0.2)), count(*) OVER (PARTITION BY user_id) - 1) THEN 'test' ELSE 'train' END AS split FROM events")
def split_per_user(df):
    return prepare.split_within(df, ["user_id"], "event_id", 0.2, rounds="some", keep=1).select("event_id", "split")


@query("events", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= round((SELECT count(*) FROM events) * 0.7) THEN 'train' ELSE 'test' END AS split FROM events")
def split_time(df):
    return prepare.split_by_time(df, "ts", "event_id", 0.7).select("event_id", "split")


@query("orders", f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {bucket(0, 'o_orderkey', 1 << 31)}, o_orderkey) - 1) % 5)::int AS fold FROM orders")
def kfold_stratified(df):
    return prepare.folds(df, "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "fold")


@query("lineitem", "WITH a AS (SELECT * FROM lineitem WHERE l_orderkey % 10 < 7), b AS (SELECT * FROM lineitem WHERE l_orderkey % 10 >= 7) SELECT l_orderkey, l_linenumber FROM b WHERE l_partkey IN (SELECT l_partkey FROM a) AND l_suppkey IN (SELECT l_suppkey FROM a)")
def common_filter(df):
    a, b = df.where("l_orderkey % 10 < 7"), df.where("l_orderkey % 10 >= 7")
    for c in ("l_partkey", "l_suppkey"):
        b = b.join(a.select(c), c, "left_semi")
    return b.select("l_orderkey", "l_linenumber")


_core, _last = "", "lineitem"
for _k in range(3):
    for _c in ("l_suppkey", "l_partkey"):
        _core += f"{'WITH ' if not _core else ', '}t{_k}{_c[2]} AS (SELECT * FROM {_last} WHERE {_c} IN (SELECT {_c} FROM {_last} GROUP BY 1 HAVING count(*) >= 28))"
        _last = f"t{_k}{_c[2]}"


@query("lineitem", f"{_core} SELECT l_orderkey, l_linenumber FROM {_last}")
def kcore_filter(df):
    return prepare.core(df, "l_suppkey", "l_partkey", 28).select("l_orderkey", "l_linenumber")


_RATINGS = "SELECT l_suppkey AS \"user\", l_partkey AS item, avg(l_quantity) AS rating FROM lineitem GROUP BY 1, 2"


def ratings(df):
    return recommend.dedup_mean(df, "l_suppkey", "l_partkey", "l_quantity")


@query("lineitem", f"SELECT \"user\", item, round(rating, 6) AS rating FROM ({_RATINGS})")
def interactions_dedup_mean(df):
    return ratings(df).withColumn("rating", F.round("rating", 6))


@query("events", "SELECT user_id, count(*) FILTER (event_type = 'click') AS \"click\", count(*) FILTER (event_type = 'error') AS \"error\", count(*) FILTER (event_type = 'purchase') AS \"purchase\", count(*) FILTER (event_type = 'signup') AS \"signup\", count(*) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY 1")
def pivot_user_item(df):
    return df.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("lineitem", f"WITH r AS ({_RATINGS}) SELECT round(count(*) / (count(DISTINCT \"user\") * count(DISTINCT item)), 9) AS density FROM r")
def density(df):
    return ratings(df).agg(F.round(F.count("*") / (F.countDistinct("user") * F.countDistinct("item")), 9).alias("density"))


@query("lineitem", "SELECT l_partkey, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_partkey LIMIT 20")
def top_users_items(df):
    return df.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("documents", "WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) >= 2 GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) >= 5), x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM f JOIN d USING (term)) SELECT doc_id AS doc, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def tfidf_weights(df):
    return prepare.tfidf(df, "doc_id", "text", 5).withColumn("weight", F.round("weight", 6))


# trees

_LABEL = "(l_returnflag = 'R')::int"


def lines(df):
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _split(df, numeric, categorical=(), criterion="gini", label="y", classes=(0, 1)):
    stats = [(F.col(label) == c).cast("double") for c in classes] if classes else [F.col(label).cast("double")]
    rows = df.select(*numeric, *categorical, F.lit(1).alias("node"), F.lit(1.0).alias("w"), *[s.alias(f"c{k}") for k, s in enumerate(stats)])
    return trees.best_splits(rows, list(numeric), list(categorical), len(stats), criterion)


def _split_sql(impurity: str) -> str:
    return f"""WITH c AS (SELECT l_quantity AS v, count(*) AS w, sum({_LABEL}) AS s FROM lineitem GROUP BY 1), u AS (SELECT v, sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER () AS aw, sum(s) OVER () AS s1, (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold FROM c WINDOW o AS (ORDER BY v)),
    g AS (SELECT threshold, round(({impurity.format(s='s1', w='aw')} - {impurity.format(s='ls', w='lw')} - {impurity.format(s='(s1 - ls)', w='(aw - lw)')}) / aw, 10) AS gain FROM u WHERE threshold IS NOT NULL)
    SELECT 'l_quantity' AS feature, threshold, round(gain, 8) AS gain FROM g ORDER BY g.gain DESC, threshold LIMIT 1"""


@query("lineitem", _split_sql("({w} - (({s}) * ({s}) + ({w} - {s}) * ({w} - {s})) / ({w})::double)"))
def gini_split_numeric(df):
    return _split(lines(df), ["l_quantity"]).select("feature", "threshold", F.round("gain", 8).alias("gain"))


_ENT = "(CASE WHEN {s} > 0 AND {s} < {w} THEN -({s}) * log2(({s})::double / {w}) - ({w} - {s}) * log2(({w} - {s})::double / {w}) ELSE 0 END)"


@query("lineitem", _split_sql(_ENT))
def entropy_split(df):
    return _split(lines(df), ["l_quantity"], criterion="entropy").select("feature", "threshold", F.round("gain", 8).alias("gain"))


@query("lineitem", f"WITH h AS (SELECT CASE WHEN {bucket(0, 'l_orderkey', 100)} >= 20 THEN l_quantity END AS v, {_LABEL} AS y FROM lineitem), c AS (SELECT v, count(*) AS w, sum(y) AS s FROM h WHERE v IS NOT NULL GROUP BY 1), u AS (SELECT v, sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER () AS aw, sum(s) OVER () AS s1, (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold FROM c WINDOW o AS (ORDER BY v)), g AS (SELECT threshold, lw / aw::double AS p, (-(s1 * s1 + (aw - s1) * (aw - s1)) / aw::double + (ls * ls + (lw - ls) * (lw - ls)) / lw::double + ((s1 - ls) * (s1 - ls) + (aw - lw - s1 + ls) * (aw - lw - s1 + ls)) / (aw - lw)::double) / (SELECT count(*) FROM h) AS gain FROM u WHERE threshold IS NOT NULL) SELECT threshold, round(round(gain, 10), 8) AS gain, round(p, 6) AS p_left FROM g ORDER BY round(g.gain, 10) DESC, threshold LIMIT 1")
def gini_split_missing_weighted(df):
    holes = prepare.inject_missing(lines(df), "l_orderkey", ["l_quantity"], 20)
    return _split(holes, ["l_quantity"]).select("threshold", F.round("gain", 8).alias("gain"), r6(F.col("p_left"), "p_left"))


@query("part", "WITH t AS (SELECT count(*) AS aw, sum(p_retailprice) AS s1 FROM part), c AS (SELECT p_brand AS category, count(*) AS lw, sum(p_retailprice) AS ls FROM part GROUP BY 1), g AS (SELECT category, round((-s1 * s1 / aw + ls * ls / lw + (s1 - ls) * (s1 - ls) / (aw - lw)) / aw, 10) AS gain FROM c, t) SELECT category, round(gain, 4) AS gain FROM g ORDER BY g.gain DESC, category LIMIT 1")
def categorical_ovr_split(df):
    return _split(df, [], ["p_brand"], "sse", "p_retailprice", None).select("category", F.round("gain", 4).alias("gain"))


@query("part", "WITH c AS (SELECT p_size::double AS v, count(*) AS w, sum(p_retailprice) AS s FROM part GROUP BY 1), u AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold, sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER () AS aw, sum(s) OVER () AS s1 FROM c WINDOW o AS (ORDER BY v)), g AS (SELECT threshold, (-s1 * s1 / aw + ls * ls / lw + (s1 - ls) * (s1 - ls) / (aw - lw)) / aw AS gain FROM u WHERE threshold IS NOT NULL) SELECT threshold, round(gain, 4) AS gain FROM g ORDER BY g.gain DESC, threshold LIMIT 1")
def sse_split(df):
    return _split(df, ["p_size"], (), "sse", "p_retailprice", None).select("threshold", F.round("gain", 4).alias("gain"))


@query("lineitem", "SELECT round(unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9])), 4) AS threshold FROM lineitem")
def quantile_thresholds(df):
    return _frame(df, [(q,) for q in quantiles(df, "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9])], "threshold double").select(F.round("threshold", 4).alias("threshold"))


def _fixed_tree() -> trees.Tree:
    n = trees.Node
    return trees.Tree({1: n([50, 50], 100, "o_totalprice", 200_000.0, None, 0.1, 0.6), 2: n([40, 20], 60, "o_orderpriority", None, "1-URGENT", 0.1, 0.25), 3: n([10, 30], 40), 4: n([9, 6], 15), 5: n([31, 14], 45)})


@query("orders", f"WITH h AS ({_HOLES}), s AS (SELECT *, CASE WHEN o_orderpriority IS NULL THEN 0.25 * 0.4 + 0.75 * 14 / 45.0 WHEN o_orderpriority = '1-URGENT' THEN 0.4 ELSE 14 / 45.0 END AS l FROM h) SELECT o_orderkey, round(CASE WHEN o_totalprice IS NULL THEN 0.6 * l + 0.4 * 0.75 WHEN o_totalprice <= 200000 THEN l ELSE 0.75 END, 6) AS share FROM s")
def tree_score_missing_mix(df):
    return with_holes(df).select("o_orderkey", r6(_fixed_tree().value(1), "share"))


def _frame(df, rows, schema):
    return df.sparkSession.createDataFrame(rows, schema)


def _grown(df, **more):
    return trees.grow(lines(df), "y", ["l_quantity", "l_discount", "l_extendedprice"], ["l_linestatus"], [0, 1], **{"depth": 3} | more)


_TREE_NUM, _TREE_CAT = ["l_quantity", "l_discount", "l_extendedprice"], ["l_linestatus"]
_TREE_ROWS = f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice, l_linestatus, {_LABEL} AS y, 1 AS w FROM lineitem"


def _tree_sql(depth: int) -> str:
    return "WITH " + ", ".join(tree_sql.grown("", _TREE_ROWS, _TREE_NUM, _TREE_CAT, depth, tree_sql.gini))


_NODES = tree_sql.nodes("", 3, _TREE_NUM + _TREE_CAT)


@query("lineitem", f"{_tree_sql(3)} SELECT node::int AS node, feature, threshold, category, weight::double AS weight FROM ({_NODES})")
def tree_nodes(df):
    return _frame(df, [(k, n.feature, n.threshold, n.category, n.weight) for k, n in sorted(_grown(df).nodes.items())], "node int, feature string, threshold double, category string, weight double")


@query("lineitem", f"{_tree_sql(2)} SELECT l_orderkey, l_linenumber, round(avg(y) OVER (PARTITION BY node), 6) AS share FROM ({tree_sql.leaves('', 2)})")
def tree_depth2(df):
    tree = _grown(df, depth=2)
    return lines(df).select("l_orderkey", "l_linenumber", r6(tree.value(1), "share"))


@query("lineitem")
def prune_rep(df):
    tree = trees.reduced_error_prune(_grown(df.where("l_orderkey % 3 > 0")), lines(df).where("l_orderkey % 3 = 0"), "y", [0, 1])
    return _frame(df, [(k, n.feature) for k, n in sorted(tree.nodes.items())], "node int, feature string")


@query("lineitem")
def prune_ccp_path(df):
    return _frame(df, trees.cost_complexity_path(_grown(df)) or [(0.0, 1)], "alpha double, leaves int")


@query("lineitem", f"{_tree_sql(3)}, g AS (SELECT feature, sum(gain * weight) AS g FROM ({_NODES}) WHERE feature IS NOT NULL GROUP BY 1) SELECT feature, round(g / sum(g) OVER (), 6) AS importance FROM g")
def tree_importance(df):
    return _frame(df, list(_grown(df).importance().items()), "feature string, importance double").withColumn("importance", F.round("importance", 6))


_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


@query("orders", "WITH e AS (SELECT o_orderkey, t.tree::int AS tree, " + bucket(0, "t.tree || ':' || o_orderkey", 1_000_000) + " / 1000000.0 AS u FROM orders, (SELECT unnest(range(3)) AS tree) t) SELECT o_orderkey, tree, CASE " + " ".join(f"WHEN u < {p} THEN {k}" for k, p in enumerate(_POISSON)) + " ELSE 7 END AS times FROM e")
def bag_rows(df):
    return prepare.bootstrap(df, "o_orderkey", 3)


_NUM, _CAT = ["o_totalprice", "o_custkey"], ["o_orderpriority"]


def _forest(df):
    df = df.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return df, trees.grow_forest(df, "o_orderkey", "y", _NUM, _CAT, [0, 1], trees=4, depth=3)


@query("orders")
def forest_oob(df):
    rows, forest = _forest(df)
    importance = forest.oob_importance(rows, "o_orderkey", "y", _NUM + _CAT)
    return _frame(df, [("all", forest.oob(rows, "o_orderkey", "y")), *importance.items()], "feature string, value double")


def _forest_sql(trees_: int, depth: int, per_node: int) -> str:
    """Each row's leaf share in every tree; a tree's bag and a node's features are drawn by the same hashes."""
    parts = []
    for t in range(trees_):
        u = bucket(0, f"'{t}:' || o_orderkey", 1_000_000) + " / 1000000.0"
        times = "CASE " + " ".join(f"WHEN {u} < {p} THEN {k}" for k, p in enumerate(_POISSON)) + " ELSE 7 END"
        rows = f"SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority, (o_orderstatus = 'F')::int AS y, {times} AS w FROM orders"
        drawn = f"SELECT node, f FROM (SELECT node, f, row_number() OVER (PARTITION BY node ORDER BY {bucket(t, "node || ':' || f", 1 << 30)}, f) AS place FROM (SELECT DISTINCT node FROM {{rows}}), (SELECT unnest(range({len(_NUM + _CAT)})) AS f)) WHERE place <= {per_node}"
        parts += tree_sql.grown(f"f{t}", rows, _NUM, _CAT, depth, tree_sql.gini, drawn)
        parts.append(f"f{t}v AS (SELECT o_orderkey, sum(w * y) OVER n / sum(w) OVER n AS v FROM ({tree_sql.leaves(f'f{t}', depth)}) WINDOW n AS (PARTITION BY node))")
    votes = " UNION ALL ".join(f"SELECT * FROM f{t}v" for t in range(trees_))
    return f"WITH {', '.join(parts)}, votes AS (SELECT o_orderkey, avg(v) AS share FROM ({votes}) GROUP BY 1) SELECT o_orderkey, (share > 0.5)::int AS predicted, round(share, 6) AS share FROM votes"


@query("orders", _forest_sql(4, 3, 2))
def forest_predict(df):
    rows, forest = _forest(df)
    return rows.select("o_orderkey", forest.predict().alias("predicted"), r6(forest.shares()[1], "share"))


_PRICED = "SELECT l_extendedprice AS target, l_quantity, l_discount FROM lineitem"
_FLAGGED = f"SELECT {_LABEL} AS target, l_quantity, l_discount, l_linestatus FROM lineitem"


@query("lineitem", "WITH " + ", ".join(tree_sql.boosted("SELECT avg(l_extendedprice) FROM lineitem", _PRICED, ["l_quantity", "l_discount"], [], 5, 0.5, False)) + " " + " UNION ALL ".join(f"SELECT {k}::int AS round, round(avg((target - score) ** 2), 2) AS mse FROM b{k + 1}" for k in range(5)))
def boost_squared(df):
    model = ensembles.boost(lines(df), "l_extendedprice", ["l_quantity", "l_discount"], rounds=5, rate=0.5)
    return _frame(df, list(enumerate(map(float, model.history))), "round int, mse double").withColumn("mse", F.round("mse", 2))


@query("lineitem", "WITH " + ", ".join(tree_sql.boosted(f"SELECT ln(avg({_LABEL}) / (1 - avg({_LABEL}))) FROM lineitem", _FLAGGED, ["l_quantity", "l_discount"], ["l_linestatus"], 5, 0.5, True)) + ", j AS (SELECT target AS y, round(1 / (1 + exp(-score)), 9) AS p FROM b5), r AS (SELECT p, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(sum(1 - y)) OVER (ORDER BY p DESC) AS fp, sum(y) AS a, sum(1 - y) AS b FROM j GROUP BY 1) SELECT (SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) FROM j) AS log_loss, (SELECT round(sum(b * (2 * tp - a)) / (2 * max(tp) * max(fp)), 6) FROM r) AS auc")
def boost_logistic(df):
    model = ensembles.boost(lines(df), "y", ["l_quantity", "l_discount"], ["l_linestatus"], "logistic", rounds=5, rate=0.5, newton=True)
    scored = lines(df).select("y", F.round(model.predict(), 9).alias("p"))
    return metrics.log_loss(scored, "y", "p").crossJoin(metrics.roc_auc(scored, "y", "p")).select(r6(F.col("log_loss"), "log_loss"), r6(F.col("auc"), "auc"))


@query("lineitem")
def boost_softmax(df):
    rows = df.select("l_quantity", "l_discount", "l_linestatus", "l_returnflag")
    model = ensembles.boost_classes(rows, "l_returnflag", ["l_quantity", "l_discount"], ["l_linestatus"], rounds=3)
    return _frame(df, list(enumerate(map(float, model.history))), "round int, log_loss double")


@query("orders")
def forest_oob_search(df):
    rows = df.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    grid = [{"trees": 3, "depth": d, "per_node": n} for d in (1, 3) for n in (1, 2)]
    best, scores = trees.search_forest(rows, "o_orderkey", "y", _NUM, _CAT, [0, 1], grid)
    return _frame(df, [(o["depth"], o["per_node"], s, o == best) for o, s in scores], "depth int, per_node int, oob double, best boolean")


# mixtures

_DIMS = [f"x{k}" for k in range(64)]


def points(df):
    return df.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(_DIMS)])


def _fixed_mixture() -> mixture.Mixture:
    """Two components at 0.1, -0.1, 0.1, ... and the opposite, all variances 0.05."""
    centre = np.array([0.1, -0.1] * 32)
    return mixture.Mixture(np.array([0.4, 0.6]), np.array([centre, -centre]), np.array([0.05 * np.eye(64)] * 2), [], 0)


def _square_sql(sign: str) -> str:
    """The squared distance from the centre of the fixed mixture with that sign."""
    return f"list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double {sign} (CASE WHEN i % 2 = 1 THEN -0.1 ELSE 0.1 END)) ** 2))"


_LOGS = f"SELECT vec_id, embedding, {_square_sql('+')} AS d0, {_square_sql('-')} AS d1, ln(0.4) - 32 * ln(2 * pi() * 0.05) - 10 * d0 AS l0, ln(0.6) - 32 * ln(2 * pi() * 0.05) - 10 * d1 AS l1 FROM embeddings"


@query("embeddings")
def kmeans_fit(df):
    centres, _ = mixture.k_means(points(df), _DIMS, 3)
    return _frame(df, [(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cluster int, centre array<double>")


@query("embeddings", f"WITH l AS ({_LOGS}), e AS (SELECT CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS cluster, unnest(range(64)) AS dim, unnest(embedding)::double AS x FROM l) SELECT cluster, dim::int AS dim, round(avg(x), 6) AS centre FROM e GROUP BY 1, 2")
def kmeans_round(df):
    centres, _ = mixture.k_means(points(df), _DIMS, 2, rounds=1, starts=_fixed_mixture().means)
    return _frame(df, [(k, i, float(x)) for k, c in enumerate(centres) for i, x in enumerate(c)], "cluster int, dim int, centre double").withColumn("centre", F.round("centre", 6))


@query("embeddings")
def gmm_fit(df):
    m = mixture.fit_mixture(points(df), _DIMS, 3, "diag", rounds=20)
    return _frame(df, [(k, float(m.weights[k]), [float(x) for x in m.means[k]], m.history[-1], m.bic("diag"), m.aic("diag")) for k in range(3)], "component int, weight double, mean array<double>, score double, bic double, aic double")


@query("embeddings", f"SELECT vec_id, round(l0, 5) AS l0, round(l1, 5) AS l1 FROM ({_LOGS})")
def gmm_e_step(df):
    logs = mixture.component_logs(points(df), _DIMS, _fixed_mixture(), ["vec_id"])
    return logs.select("vec_id", F.round(F.col("logs")[0], 5).alias("l0"), F.round(F.col("logs")[1], 5).alias("l1"))


@query("embeddings", f"WITH l AS ({_LOGS}), r AS (SELECT embedding, unnest([0, 1]) AS component, unnest([1 / (1 + exp(l1 - l0)), 1 / (1 + exp(l0 - l1))]) AS r FROM l), e AS (SELECT component, r, unnest(range(64)) AS dim, unnest(embedding)::double AS x FROM r) SELECT component, dim::int AS dim, round(sum(r) / (SELECT count(*) FROM embeddings), 6) AS weight, round(sum(r * x) / sum(r), 6) AS mean, round(sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) ** 2 + 1e-6, 6) AS variance FROM e GROUP BY 1, 2")
def gmm_m_step(df):
    m = mixture.em_round(points(df), _DIMS, _fixed_mixture(), "diag")
    cells = [(k, i, float(m.weights[k]), float(m.means[k][i]), float(m.covs[k][i][i])) for k in range(2) for i in range(64)]
    return _frame(df, cells, "component int, dim int, weight double, mean double, variance double").select("component", "dim", *[r6(F.col(c), c) for c in ("weight", "mean", "variance")])


# recommenders


_BY_PART = "SELECT l_partkey AS \"user\", l_suppkey AS item, avg(l_quantity) AS rating FROM lineitem GROUP BY 1, 2"


@query("lineitem", f"WITH r AS ({_BY_PART}) SELECT a.item AS a, b.item AS b, round(sum(a.rating * b.rating), 4) AS g FROM r a JOIN r b USING (\"user\") GROUP BY 1, 2")
def gram_items(df):
    return recommend.gram(recommend.dedup_mean(df, "l_partkey", "l_suppkey", "l_quantity")).select("a", "b", F.round("g", 4).alias("g"))


@query("lineitem", f"WITH r AS ({_RATINGS}), g AS (SELECT a.item AS a, b.item AS b, sum(a.rating * b.rating) AS g FROM r a JOIN r b USING (\"user\") WHERE a.item <> b.item GROUP BY 1, 2), n AS (SELECT item, sqrt(sum(rating * rating)) AS n FROM r GROUP BY 1), c AS (SELECT a, b, round(g / (x.n * y.n), 9) AS s FROM g JOIN n x ON x.item = a JOIN n y ON y.item = b), k AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM c) SELECT a, rank::int AS rank, round(s, 6) AS similarity FROM k WHERE rank <= 5")
def cosine_topk(df):
    return recommend.neighbours(ratings(df), 5).select("a", F.col("rank").cast("int").alias("rank"), r6(F.col("similarity"), "similarity"))


_PAIRS = "SELECT l_suppkey AS \"user\", l_partkey AS item, avg(l_quantity) AS rating, max(l_linenumber) AS gain, " + bucket(0, "l_suppkey || ':' || l_partkey", 100) + " < 10 AS held FROM lineitem GROUP BY 1, 2"
_SCORES = f"WITH pairs AS MATERIALIZED ({_PAIRS}), r AS (SELECT \"user\", item, rating FROM pairs WHERE NOT held), w AS (SELECT item AS src, (item * 7 + k * 131) % (SELECT max(item) FROM r) + 1 AS dst, 1 / (1.0 + (item + k) % 5) AS weight FROM (SELECT DISTINCT item FROM r), (SELECT unnest(range(5)) AS k)), s AS (SELECT \"user\", dst AS item, sum(rating * weight) AS score FROM r JOIN w ON r.item = w.src GROUP BY 1, 2)"


def _pairs(df, held):
    """One in ten pairs of user and item is held out; the others are the ratings."""
    pairs = df.groupBy(F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating"), F.max("l_linenumber").alias("gain"))
    return pairs.where((hash_bucket(F.concat_ws(":", "user", "item"), 0, 100) < 10) == F.lit(held)).select("user", "item", "gain" if held else "rating")


def _weighted(df):
    """Ratings and a fixed table of five weights an item, spread over all items."""
    r = written(_pairs(df, False))
    most = r.agg(F.max("item")).head()[0] or 1
    edges = r.select(F.col("item").alias("src")).distinct().select("src", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return r, edges.select("src", ((F.col("src") * 7 + F.col("k") * 131) % most + 1).alias("dst"), (1 / (1.0 + (F.col("src") + F.col("k")) % 5)).alias("weight"))


@query("lineitem", f"{_SCORES} SELECT \"user\", item, round(score, 4) AS score FROM s")
def slim_predict(df):
    return recommend.linear_scores(*_weighted(df)).withColumn("score", F.round("score", 4))


_TOP = f"{_SCORES}, t AS (SELECT \"user\", item, round(score, 6) AS score FROM s ANTI JOIN r USING (\"user\", item)), k AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, item)::int AS rank FROM t)"


def _top(df, k=5):
    r, w = _weighted(df)
    fresh = recommend.marked_scores(r, w, r).where("NOT marked").select("user", "item", F.round("score", 6).alias("score"))
    return r, metrics.top_k(fresh, "user", "item", "score", k)


@query("lineitem", f"{_TOP} SELECT \"user\", item, rank FROM k WHERE rank <= 5")
def topk_unseen(df):
    return _top(df)[1].select("user", "item", "rank")


@query("lineitem", f"{_SCORES}, q AS (SELECT \"user\", item, round(score, 6) AS score FROM s), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, item) AS n FROM q) WHERE n <= 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, item) AS n FROM q ANTI JOIN r USING (\"user\", item)) WHERE n <= 2), u AS (SELECT \"user\", item, score FROM a UNION SELECT \"user\", item, score FROM b) SELECT \"user\", item, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, item)::int AS rank FROM u")
def topk_explore_combine(df):
    r, w = _weighted(df)
    return recommend.explore_and_exploit(recommend.marked_scores(r, w, r).withColumn("score", F.round("score", 6)), None, 5, 2).select("user", "item", "rank")


_HELD = "h AS (SELECT \"user\", item, gain FROM pairs WHERE held)"


def _ranking_sql(gain: str) -> str:
    return f"{_TOP}, {_HELD}, x AS (SELECT \"user\", item, {gain} AS g FROM h), i AS (SELECT \"user\", count(*) AS n, sum(CASE WHEN p <= 5 THEN g / log2(p + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY g DESC, item) AS p FROM x) GROUP BY 1), f AS (SELECT \"user\", count(*) AS hits, sum(g / log2(rank + 1)) AS dcg FROM k JOIN x USING (\"user\", item) WHERE rank <= 5 GROUP BY 1) SELECT round(avg(coalesce(hits, 0) / 5), 6) AS precision, round(avg(coalesce(hits, 0) / n), 6) AS recall, round(avg(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END), 6) AS ndcg FROM i LEFT JOIN f USING (\"user\")"


def _held(df):
    return _pairs(df, True)


def _ranked(df, exponential):
    return metrics.ranking(_top(df)[1], _held(df), "user", "item", "gain", 5, exponential).select(*[r6(F.col(c), c) for c in ("precision", "recall", "ndcg")])


@query("lineitem", _ranking_sql("gain::double"))
def ndcg_linear(df):
    return _ranked(df, False)


@query("lineitem", _ranking_sql("2.0 ** gain - 1"))
def ndcg_exp(df):
    return _ranked(df, True)


@query("lineitem", f"{_SCORES}, {_HELD}, k AS (SELECT \"user\", item, row_number() OVER (PARTITION BY \"user\" ORDER BY round(score, 6) DESC, item) AS rank, gain::double AS g FROM s JOIN h USING (\"user\", item)), i AS (SELECT \"user\", sum(CASE WHEN p <= 5 THEN g / log2(p + 1) ELSE 0 END) AS ideal FROM (SELECT \"user\", gain::double AS g, row_number() OVER (PARTITION BY \"user\" ORDER BY gain DESC, item) AS p FROM h) GROUP BY 1), f AS (SELECT \"user\", sum(g / log2(rank + 1)) AS dcg FROM k WHERE rank <= 5 GROUP BY 1) SELECT round(avg(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END), 6) AS ndcg FROM i LEFT JOIN f USING (\"user\")")
def ndcg_test_only(df):
    held = _held(df)
    top = metrics.top_k(recommend.marked_scores(*_weighted(df), held).where("marked").withColumn("score", F.round("score", 6)), "user", "item", "score", 5)
    return metrics.ranking(top, held, "user", "item", "gain", 5).select(r6(F.col("ndcg"), "ndcg"))


@query("lineitem", f"WITH t AS (SELECT l_partkey, avg(l_quantity) AS m FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1) SELECT round(sqrt(avg((l_quantity - m) ** 2)), 6) AS rmse, round(avg(abs(l_quantity - m)), 6) AS mae, round(1 - sum((l_quantity - m) ** 2) / (var_pop(l_quantity) * count(*)), 6) AS r2 FROM lineitem JOIN t USING (l_partkey) WHERE l_orderkey % 5 = 0")
def rmse_holdout(df):
    train = df.where("l_orderkey % 5 > 0").groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"))
    return metrics.regression(df.where("l_orderkey % 5 = 0").join(train, "l_partkey"), "l_quantity", "m").select(*[r6(F.col(c), c) for c in ("rmse", "mae", "r2")])


def _by_type(df):
    """Users' mean values of the few event types: a dense item-item model of all events stays small."""
    return recommend.dedup_mean(df, "user_id", "event_type", "value")


@query("events")
def ease_weights(df):
    return recommend.ease(_by_type(df)).select("src", "dst", r6(F.col("weight"), "weight"))


@query("events")
def slim_cd_fit(df):
    return recommend.slim(_by_type(df)).select("src", "dst", r6(F.col("weight"), "weight"))


@query("events")
def lsa_fit(df):
    return recommend.latent_semantic(_by_type(df), 2).select("src", "dst", r6(F.col("weight"), "weight"))


@query("lineitem")
def als_fit(df):
    r = ratings(df)
    said = recommend.factor_scores(r, *recommend.als(r, 4, 4))
    return metrics.regression(said, "rating", "score")


_FACTOR = lambda k: f"({bucket(0, f"item || ':{k}'", 20_001)} / 20000.0 - 0.5) * 0.2"


@query("lineitem", f"WITH r AS ({_RATINGS}), f AS (SELECT \"user\", rating, {_FACTOR(0)} AS p, {_FACTOR(1)} AS q FROM r), m AS (SELECT \"user\", sum(p * p) + 0.05 * count(*) AS a, sum(p * q) AS b, sum(q * q) + 0.05 * count(*) AS c, sum(p * rating) AS x, sum(q * rating) AS y FROM f GROUP BY 1) SELECT \"user\", round((x * c - y * b) / (a * c - b * b), 5) AS f0, round((y * a - x * b) / (a * c - b * b), 5) AS f1 FROM m")
def als_half_step(df):
    r = ratings(df)
    items = recommend.start_factors(r.select("item").distinct(), "item", 2, 0)
    users = recommend.solved(r, "user", "item", items, 2, 0.05)
    return users.select(F.col("id").alias("user"), *[F.round(F.col("f")[k], 5).alias(f"f{k}") for k in range(2)])


@query("lineitem")
def lfm_fit(df):
    r = ratings(df)
    mean, users, items = recommend.latent_factors(r, 4, 5)
    b = recommend.factor_scores(r, users, items).join(users.select(F.col("id").alias("user"), F.col("bias").alias("bu")), "user").join(items.select(F.col("id").alias("item"), F.col("bias").alias("bi")), "item")
    return metrics.regression(b.withColumn("score", F.col("score") + mean + F.col("bu") + F.col("bi")), "rating", "score")


@query("lineitem")
def nmf_fit(df):
    r = ratings(df)
    return metrics.regression(recommend.factor_scores(r, *recommend.non_negative(r, 4, 5)), "rating", "score")


# metrics

_JUDGED = f"SELECT l_orderkey, {_LABEL} AS y, (l_quantity > 25)::int AS yhat, round(l_quantity / 51, 6) AS p FROM lineitem"


def judged(df):
    return lines(df).select("l_orderkey", "y", (F.col("l_quantity") > 25).cast("int").alias("yhat"), F.round(F.col("l_quantity") / 51, 6).alias("p"))


@query("lineitem", f"SELECT y AS actual, yhat AS predicted, count(*) AS n FROM ({_JUDGED}) GROUP BY 1, 2")
def confusion(df):
    return metrics.confusion(judged(df), "y", "yhat")


@query("lineitem", f"WITH j AS ({_JUDGED}), c AS (SELECT k, count(*) FILTER (y = k AND yhat = k) AS h, count(*) FILTER (y = k) AS a, count(*) FILTER (yhat = k) AS s FROM j, (SELECT unnest([0, 1]) AS k) GROUP BY 1), p AS (SELECT h, a, h / s AS p, h / a AS r FROM c) SELECT round(sum(h) / sum(a), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / (p + r)), 6) AS f1 FROM p")
def prf_macro(df):
    return metrics.classification(judged(df), "y", "yhat").select(*[r6(F.col(c), c) for c in ("accuracy", "precision", "recall", "f1")])


_ROC = f"r AS (SELECT p AS score, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(sum(1 - y)) OVER (ORDER BY p DESC) AS fp FROM ({_JUDGED}) GROUP BY 1)"


@query("lineitem", f"WITH {_ROC} SELECT score, tp::bigint AS tp, fp::bigint AS fp FROM r")
def roc_curve(df):
    return metrics.roc(judged(df), "y", "p")


@query("lineitem", f"WITH {_ROC} SELECT round(sum(dx * y2) / (2 * max(tp) * max(fp)), 6) AS auc FROM (SELECT tp, fp, fp - lag(fp, 1, 0) OVER (ORDER BY score DESC) AS dx, tp + lag(tp, 1, 0) OVER (ORDER BY score DESC) AS y2 FROM r)")
def roc_auc(df):
    return metrics.roc_auc(judged(df), "y", "p").select(r6(F.col("auc"), "auc"))


@query("lineitem", f"WITH {_ROC} SELECT round(sum(d * tp / (tp + fp)) / max(tp), 6) AS average_precision FROM (SELECT tp, fp, tp - lag(tp, 1, 0) OVER (ORDER BY score DESC) AS d FROM r)")
def average_precision(df):
    return metrics.average_precision(judged(df), "y", "p").select(r6(F.col("average_precision"), "average_precision"))


@query("lineitem", f"SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM ({_JUDGED})")
def log_loss(df):
    return metrics.log_loss(judged(df), "y", "p").select(r6(F.col("log_loss"), "log_loss"))


def _halves(df):
    """A cluster by the signs of the sums of the first and the second half of a vector."""
    total = lambda names: sum((F.col(c) for c in names), F.lit(0.0))
    return points(df).select("label", ((total(_DIMS[:32]) > 0).cast("int") * 2 + (total(_DIMS[32:]) > 0).cast("int")).alias("c"))


@query("embeddings", "WITH p AS (SELECT label AS a, (list_sum(embedding[1:32]::double[]) > 0)::int * 2 + (list_sum(embedding[33:64]::double[]) > 0)::int AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS s FROM c), m AS (SELECT sum(n / t * ln(n * t / (ra * cb))) AS mi FROM c JOIN ra USING (a) JOIN cb USING (b), t), ha AS (SELECT sum(ra * (ra - 1) / 2) AS sa, -sum(ra / t * ln(ra / t)) AS ha FROM ra, t), hb AS (SELECT sum(cb * (cb - 1) / 2) AS sb, -sum(cb / t * ln(cb / t)) AS hb FROM cb, t) SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM t, m, ha, hb")
def ari_nmi(df):
    marked = _halves(df)
    return metrics.clustering(marked, "label", "c").select(r6(F.col("ari"), "ari"), r6(F.col("nmi"), "nmi"))


@query("embeddings")
def cluster_accuracy(df):
    centres, _ = mixture.k_means(points(df), _DIMS, 4)
    fitted = mixture.Mixture(np.full(4, 0.25), centres, np.array([np.eye(64)] * 4), [], 0)
    marked = mixture.assign(points(df), _DIMS, fitted, ["label"]).withColumnRenamed("component", "c")
    return _frame(df, [(metrics.cluster_accuracy(marked, "label", "c"),)], "accuracy double")


@query("orders", f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {bucket(0, 'o_orderkey', 1 << 31)}, o_orderkey) AS p FROM orders) WHERE p <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))")
def undersample(df):
    return prepare.undersample(df, "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus")
