"""Further registered queries: splits, filters, metrics, recommenders and sinks. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import comparators, metrics, prepare, recommend
from millrace.sources.sinks import write_csv, write_json, write_markdown
from millrace.sources.storage import shared_dir, written

from .catalog import _JUDGED, _LABEL, _PAIRS, _RATINGS, _TOP, _held, _HELD, _pairs, _split, _top, bucket, judged, lines, query, r6, ratings

# splits and filters

_DEALT = f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {bucket(0, 'o_orderkey', 1 << 31)}, o_orderkey) AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"


@query("orders", f"SELECT o_orderkey, CASE WHEN p <= floor(n * 0.6) THEN 'train' WHEN p <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split FROM ({_DEALT})")
def split_three_way(df):
    return prepare.split_three_ways(df, "o_orderstatus", "o_orderkey").select("o_orderkey", "split")


@query("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 28) AND l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 28)")
def min_count_filter(df):
    return prepare.with_least(df, ["l_suppkey", "l_partkey"], 28).select("l_orderkey", "l_linenumber")


@query("lineitem", "WITH u AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 28)) SELECT l_orderkey, l_linenumber FROM u WHERE l_partkey IN (SELECT l_partkey FROM u GROUP BY 1 HAVING count(*) >= 28)")
def min_count_sequential(df):
    return prepare.core(df, "l_suppkey", "l_partkey", 28, passes=1).select("l_orderkey", "l_linenumber")


@query("customer", "SELECT c_custkey, round(c_acctbal / (SELECT sqrt(sum(c_acctbal * c_acctbal)) FROM customer), 9) AS x FROM customer")
def scale_unit_column(df):
    return prepare.unit_columns(df, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 9).alias("x"))


@query("lineitem", "WITH f AS (SELECT l_partkey, min(l_orderkey) AS m FROM lineitem GROUP BY 1) SELECT l_partkey, row_number() OVER (ORDER BY m, l_partkey) - 1 AS code FROM f")
def codes_by_appearance(df):
    return prepare.codes_by_appearance(df, "l_partkey", "l_orderkey")


@query("orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p = 1")
def first_order_of_customer(df):
    return prepare.first_of_each(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("orders", "SELECT a.o_orderkey AS dear, b.o_orderkey AS late FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS p FROM orders) b USING (p)")
def positional_join(df):
    dear, late = df.select(F.col("o_orderkey").alias("dear"), "o_totalprice"), df.select(F.col("o_orderkey").alias("late"), "o_orderdate")
    return prepare.beside(dear, late, [F.desc("o_totalprice"), F.col("dear")], [F.desc("o_orderdate"), F.col("late")]).select("dear", "late")


@query("part", "SELECT p_partkey AS part_key, p_name AS part_name FROM part")
def plain_column_names(df):
    return prepare.plain_names(df.select(F.col("p_partkey").alias(" Part  Key"), F.col("p_name").alias("part-NAME ")))


@query("orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def checked_labels(df):
    return prepare.checked_labels(df, "o_orderstatus", ["F", "O", "P"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_USER_ROWS = f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY {bucket(0, 'event_id', 1 << 31)}, event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events"


@query("events", f"SELECT event_id, CASE WHEN p <= least(greatest(1, round_even(n * 0.25, 0)), n - 1) THEN 'test' ELSE 'train' END AS split FROM ({_USER_ROWS})")
def split_per_user_rounded(df):
    return prepare.split_within(df, ["user_id"], "event_id", 0.25, rounds="near", keep=1).select("event_id", "split")


@query("events", f"SELECT event_id, CASE WHEN p <= least(greatest(1, round_even(n * 0.25, 0)), n - 8) THEN 'test' ELSE 'train' END AS split FROM ({_USER_ROWS})")
def split_keeping_rows(df):
    """As much as leaves eight rows of each user in train."""
    return prepare.split_within(df, ["user_id"], "event_id", 0.25, rounds="near", keep=8).select("event_id", "split")


@query("orders", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN row_number() OVER (ORDER BY {bucket(k, 'o_orderkey', 1 << 31)}, o_orderkey) > (SELECT floor(count(*) * 0.1) FROM orders) THEN {c} END AS {c}" for k, c in enumerate(("o_totalprice", "o_orderpriority"))) + " FROM orders")
def inject_missing_share(df):
    return prepare.inject_missing_share(df.select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey", ["o_totalprice", "o_orderpriority"], 0.1)


@query("orders", "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), d AS (SELECT DISTINCT ('0x' || substr(md5('0:0:' || i), 1, 15))::bigint % (2 * (SELECT count(*) FROM orders)) AS c FROM (SELECT unnest(range((SELECT floor(count(*) * 2 * 0.1)::bigint FROM orders))) AS i)) SELECT o_orderkey, CASE WHEN 2 * p NOT IN (SELECT c FROM d) THEN o_totalprice END AS o_totalprice, CASE WHEN 2 * p + 1 NOT IN (SELECT c FROM d) THEN o_orderpriority END AS o_orderpriority FROM r")
def inject_missing_cells(df):
    return prepare.inject_missing_cells(df.select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey", ["o_totalprice", "o_orderpriority"], 0.1)


@query("documents", "WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) >= 2 AND term NOT IN ('the', 'der', 'la') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) BETWEEN 5 AND 0.4 * (SELECT count(*) FROM documents) ORDER BY sum(tf) DESC, term LIMIT 300), x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM f JOIN d USING (term)) SELECT doc_id AS doc, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def tfidf_most_frequent(df):
    return prepare.tfidf(df, "doc_id", "text", 5, stop=("the", "der", "la"), max_df=0.4, most_terms=300).withColumn("weight", F.round("weight", 6))


# splits of trees


def _named_split_sql(impurity: str) -> str:
    return f"""WITH c AS (SELECT l_quantity AS v, count(*) AS w, sum({_LABEL}) AS s FROM lineitem GROUP BY 1),
    u AS (SELECT sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER () AS aw, sum(s) OVER () AS s1, (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold FROM c WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT threshold, round(({impurity.format(s='s1', w='aw')} - {impurity.format(s='ls', w='lw')} - {impurity.format(s='(s1 - ls)', w='(aw - lw)')}) / aw, 10) AS gain FROM u WHERE threshold IS NOT NULL)
    SELECT threshold, round(gain, 8) AS gain FROM g ORDER BY g.gain DESC, threshold LIMIT 1"""


@query("lineitem", _named_split_sql("({w} - greatest({s}, {w} - {s}))"))
def misclassification_split(df):
    return _split(lines(df), ["l_quantity"], criterion="misclassification").select("threshold", F.round("gain", 8).alias("gain"))


@query("lineitem", _named_split_sql("(4.0 * {s} * ({w} - {s}) / {w})"))
def quarter_split(df):
    return _split(lines(df), ["l_quantity"], criterion="quarter").select("threshold", F.round("gain", 8).alias("gain"))


# metrics

_CLASSES = f"c AS (SELECT k, count(*) FILTER (y = k AND yhat = k) AS h, count(*) FILTER (y = k) AS a, count(*) FILTER (yhat = k) AS s FROM ({_JUDGED}), (SELECT unnest([0, 1]) AS k) GROUP BY 1), p AS (SELECT a, coalesce(h / nullif(s, 0), 0) AS p, coalesce(h / nullif(a, 0), 0) AS r FROM c)"


@query("lineitem", f"WITH {_CLASSES} SELECT round(sum(p * a) / sum(a), 6) AS precision, round(sum(r * a) / sum(a), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * a) / sum(a), 6) AS f1, round(avg(r) FILTER (a > 0), 6) AS balanced_accuracy FROM p")
def prf_weighted(df):
    return metrics.classification_weighted(judged(df), "y", "yhat").select(*[r6(F.col(c), c) for c in ("precision", "recall", "f1", "balanced_accuracy")])


@query("lineitem", f"WITH r AS (SELECT p AS score, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(sum(1 - y)) OVER (ORDER BY p DESC) AS fp FROM ({_JUDGED}) GROUP BY 1) SELECT score AS threshold, round(2 * tp / (tp + fp + (SELECT sum(y) FROM ({_JUDGED}))), 6) AS f1 FROM r ORDER BY 2 * tp / (tp + fp + (SELECT sum(y) FROM ({_JUDGED}))) DESC, score DESC LIMIT 1")
def best_f1_threshold(df):
    return metrics.best_f1(judged(df), "y", "p").select("threshold", r6(F.col("f1"), "f1"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity > 25)::int + (l_discount > 0.05)::int + (l_tax > 0.04)::int >= 2 THEN 1 ELSE 0 END AS voted FROM lineitem")
def hard_vote(df):
    votes = [(F.col(c) > x).cast("int") for c, x in (("l_quantity", 25), ("l_discount", 0.05), ("l_tax", 0.04))]
    return df.select("l_orderkey", "l_linenumber", metrics.hard_vote(votes).alias("voted"))


_FOLDED = f"SELECT *, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {bucket(0, 'o_orderkey', 1 << 31)}, o_orderkey) - 1) % 5) AS fold FROM orders"


@query("orders", f"WITH f AS (SELECT o_orderstatus, fold, avg(o_totalprice) AS m FROM ({_FOLDED}) GROUP BY 1, 2) SELECT o_orderstatus, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS deviation FROM f GROUP BY 1")
def fold_summary(df):
    folded = prepare.folds(df, "o_orderstatus", "o_orderkey", 5).groupBy("o_orderstatus", "fold").agg(F.avg("o_totalprice").alias("m"))
    return metrics.over_folds(folded, ["o_orderstatus"], "m").select("o_orderstatus", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


@query("lineitem", f"{_TOP}, {_HELD}, x AS (SELECT \"user\", item FROM h), i AS (SELECT \"user\", count(*) AS n FROM x GROUP BY 1), d AS (SELECT \"user\", sum(1 / log2(rank + 1)) AS dcg FROM k JOIN x USING (\"user\", item) WHERE rank <= 5 GROUP BY 1), z AS (SELECT n, dcg, list_sum(list_transform(range(1, least(n, 5) + 1), lambda q: 1 / log2(q + 1))) AS ideal FROM i LEFT JOIN d USING (\"user\")) SELECT round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg FROM z")
def ndcg_binary(df):
    held = _held(df).withColumn("gain", F.lit(1))
    return metrics.ranking(_top(df)[1], held, "user", "item", "gain", 5).select(r6(F.col("ndcg"), "ndcg"))


_COSINE = "g AS (SELECT a.item AS a, b.item AS b, sum(a.rating * b.rating) AS g FROM r a JOIN r b USING (\"user\") WHERE a.item <> b.item GROUP BY 1, 2), n AS (SELECT item, sqrt(sum(rating * rating)) AS n FROM r GROUP BY 1), c AS (SELECT a, b, round(g / (x.n * y.n), 9) AS s FROM g JOIN n x ON x.item = a JOIN n y ON y.item = b), w AS (SELECT a, b, round(s, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM c) WHERE place <= 10)"


@query("lineitem", f"WITH pairs AS MATERIALIZED ({_PAIRS}), r AS (SELECT \"user\", item, rating FROM pairs WHERE NOT held), {_HELD}, {_COSINE}, s AS (SELECT \"user\", a AS item, round(sum(rating * weight), 6) AS score FROM r JOIN w ON r.item = w.b GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, item) AS rank FROM s ANTI JOIN r USING (\"user\", item)), f AS (SELECT \"user\", count(*) AS hits FROM t JOIN h USING (\"user\", item) WHERE rank <= 20 GROUP BY 1), each AS (SELECT \"user\", count(*) AS n FROM h GROUP BY 1) SELECT round(avg(coalesce(hits, 0) / 20), 6) AS precision, round(avg(coalesce(hits, 0) / n), 6) AS recall FROM each LEFT JOIN f USING (\"user\")")
def rank_by_neighbours(df):
    """A fitted model judged on pairs that it has not seen: an item's score is its ten neighbours' ratings by cosine."""
    r = written(_pairs(df, False))
    w = recommend.neighbours(r, 10).select(F.col("b").alias("src"), F.col("a").alias("dst"), F.round("similarity", 6).alias("weight"))
    found = metrics.ranking(recommend.best_unseen(r, w, 20, 6), _held(df), "user", "item", "gain", 20)
    return found.select(r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query("lineitem", f"{_TOP}, {_HELD} SELECT round(sqrt(avg((coalesce(score, 0) - coalesce(gain, 0)) ** 2)), 6) AS rmse FROM (SELECT \"user\", item, score FROM k WHERE rank <= 5) FULL JOIN h USING (\"user\", item)")
def rmse_topk_outer(df):
    return metrics.outer_rmse(_top(df)[1], _held(df), "user", "item", "score", "gain").select(r6(F.col("rmse"), "rmse"))


# recommenders


@query("lineitem", f"WITH r AS ({_RATINGS}), p AS (SELECT item, count(*) AS n, round(avg(rating), 6) AS mean, row_number() OVER (ORDER BY count(*) DESC, round(avg(rating), 6) DESC, item)::int AS rank FROM (SELECT item, rating FROM r) GROUP BY 1) SELECT * FROM p WHERE rank <= 20")
def popular_items(df):
    return recommend.popular(ratings(df), 20).withColumn("mean", F.round("mean", 6))


_SPREAD = "w AS (SELECT item AS src, (item * 7 + k * 131) % (SELECT max(item) FROM r) + 1 AS dst, ((item + k) % 11 - 3)::double AS weight FROM (SELECT DISTINCT item FROM r), (SELECT unnest(range(5)) AS k))"


def _spread(r):
    """Five weights an item, whole numbers, to places over all items."""
    most = r.agg(F.max("item")).head()[0] or 1
    edges = r.select(F.col("item").alias("src")).distinct().select("src", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return edges.select("src", ((F.col("src") * 7 + F.col("k") * 131) % most + 1).alias("dst"), ((F.col("src") + F.col("k")) % 11 - 3).cast("double").alias("weight"))


@query("lineitem", f"WITH r AS ({_RATINGS}), {_SPREAD} SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS p FROM w WHERE weight > 0) WHERE p <= 3")
def largest_weights(df):
    return recommend.keep_largest(_spread(ratings(df)), 3).select("src", "dst")


@query("lineitem", f"WITH r AS ({_RATINGS}), {_SPREAD}, s AS (SELECT \"user\", dst AS item, round(sum(rating * weight), 9) / nullif(sum(abs(weight)), 0) AS score FROM r JOIN w ON r.item = w.src GROUP BY 1, 2) SELECT \"user\", item, round(greatest(1.0, least(50.0, coalesce(score, 25.0))), 6) AS score FROM r LEFT JOIN s USING (\"user\", item)")
def predict_weighted_average(df):
    r = ratings(df)
    return recommend.weighted_average(r.select("user", "item"), r, _spread(r), 25.0, 1.0, 50.0).withColumn("score", F.round("score", 6))


# sinks: written, read back


def _stored(df, write, read):
    path = shared_dir(df.sparkSession)
    write(df, path)
    return read(df.sparkSession.read.schema(df.schema), path)


_SUMMARY = "SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1"


def _summary(df):
    return df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("orders", _SUMMARY)
def sink_csv(df):
    return _stored(_summary(df), write_csv, lambda reader, path: reader.option("header", True).csv(path))


@query("orders", _SUMMARY)
def sink_json(df):
    return _stored(_summary(df), write_json, lambda reader, path: reader.json(path))


@query("orders", "SELECT '| priority | n |' AS value UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || o_orderpriority || ' | ' || count(*) || ' |' FROM orders GROUP BY o_orderpriority")
def sink_markdown(df):
    counts = df.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    path = shared_dir(df.sparkSession)
    write_markdown(counts, path, ["priority"])
    return df.sparkSession.read.text(path)


# beside pyspark.ml


@query("lineitem")
def compare_classifiers(df):
    rows = df.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), "l_orderkey", "l_quantity", "l_discount", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y")).dropDuplicates(["key"])
    found = comparators.compare_classifiers(rows.where("l_orderkey % 4 > 0"), rows.where("l_orderkey % 4 = 0"), "key", "y", ["l_quantity", "l_discount", "l_extendedprice"], depth=3, trees_=5, rounds=3)
    return found.select("model", "library", "accuracy")


@query("lineitem")
def compare_factors(df):
    held = df.groupBy(F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating")).join(_held(df).select("user", "item"), ["user", "item"])
    return comparators.compare_factors(_pairs(df, False), held, 4, 3).select("library", "rmse")
