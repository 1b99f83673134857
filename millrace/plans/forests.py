"""Registered queries of bounded splits, exact bags, out-of-bag drops and step searches. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.expressions import hash_bucket
from millrace.operators import ensembles, histogram, prepare, pruning, trees

from . import tree_sql
from .catalog import _LABEL, _frame, bucket, lines, query, r6

# draws of rows


def _place(tree: str, draw: str, n: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {tree} || ':' || {draw}), 1, 15))::bigint % {n})"


def _bag(trees: int) -> str:
    """(tree, o_orderkey, times) of an exact bootstrap of orders."""
    n = "(SELECT count(*) FROM orders)"
    return f"SELECT tree::int AS tree, o_orderkey, count(*)::int AS times FROM (SELECT i // {n} AS tree, {_place(f'(i // {n})', f'(i % {n})', n)} AS place FROM (SELECT unnest(range({trees} * {n})) AS i)) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) USING (place) GROUP BY 1, 2"


@query("orders", _bag(3))
def bag_exact(df):
    return prepare.drawn_with_replacement(df, "o_orderkey", 3)


@query("orders", _bag(3).replace("* (SELECT count(*) FROM orders)", "* 500").replace("i // (SELECT count(*) FROM orders)", "i // 500").replace("i % (SELECT count(*) FROM orders)", "i % 500"))
def bag_fixed_size(df):
    return prepare.drawn_with_replacement(df, "o_orderkey", 3, 500)


@query("orders", f"SELECT o_orderkey, tree, 1 AS times FROM (SELECT o_orderkey, tree, row_number() OVER (PARTITION BY tree ORDER BY {bucket(0, "tree || ':' || o_orderkey", 1 << 31)}, o_orderkey) AS p FROM orders, (SELECT unnest(range(3))::int AS tree)) WHERE p <= (SELECT round(count(*) * 0.632) FROM orders)")
def bag_share(df):
    return prepare.drawn_without_replacement(df, "o_orderkey", 3, 0.632)


# bounded splits


def _bin(column: str, table: str, bins: int) -> str:
    """The place of a value among the table's quantiles, from 1."""
    edges = f"(SELECT list_distinct(quantile_cont({column}::double, {[k / bins for k in range(1, bins)]})) FROM {table})"
    return f"list_count(list_filter({edges}, lambda e: e < {column})) + 1"


_CUT = f"SELECT l_orderkey, l_linenumber, {_bin('l_extendedprice', 'lineitem', 32)} AS b, l_quantity, l_linestatus, {_LABEL} AS y, 1 AS w FROM lineitem"


def _bounded(df):
    return histogram.grow_binned(lines(df), "y", ["l_extendedprice", "l_quantity"], ["l_linestatus"], [0, 1], bins=32, depth=3)


@query("lineitem", f"WITH {', '.join(tree_sql.grown('', _CUT.replace('l_quantity,', _bin('l_quantity', 'lineitem', 32) + ' AS q,'), ['b', 'q'], ['l_linestatus'], 3, tree_sql.gini))} SELECT l_orderkey, l_linenumber, round(avg(y) OVER (PARTITION BY node), 6) AS share FROM ({tree_sql.leaves('', 3)})")
def tree_bounded(df):
    return lines(df).select("l_orderkey", "l_linenumber", r6(_bounded(df).value(1), "share"))


# a forest of bounded splits on exact bags

_TREES, _DEPTH, _BINS = 3, 3, 16
_FNUM, _FCAT = ["o_totalprice", "o_custkey"], ["o_orderpriority"]
_FBINS = f"SELECT o_orderkey, {_bin('o_totalprice', 'orders', _BINS)} AS b0, {_bin('o_custkey', 'orders', _BINS)} AS b1, o_orderpriority, (o_orderstatus = 'F')::int AS y FROM orders"


def _binned_forest(df):
    rows = df.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return ensembles.grow_binned_forest(rows, "o_orderkey", "y", _FNUM, _FCAT, [0, 1], trees=_TREES, depth=_DEPTH, per_node=2, bins=_BINS)


def _forest_parts() -> str:
    """Common table expressions: rows, the bags, each tree f{t}, and f{t}v, the class share of its nodes."""
    parts = [f"rows AS MATERIALIZED ({_FBINS})", f"bags AS MATERIALIZED ({_bag(_TREES)})"]
    for t in range(_TREES):
        source = f"SELECT rows.*, coalesce(times, 0) AS w FROM rows LEFT JOIN (SELECT * FROM bags WHERE tree = {t}) USING (o_orderkey)"
        drawn = f"SELECT node, f FROM (SELECT node, f, row_number() OVER (PARTITION BY node ORDER BY {bucket(t, "node || ':' || f", 1 << 30)}, f) AS place FROM (SELECT DISTINCT node FROM {{rows}}), (SELECT unnest(range(3)) AS f)) WHERE place <= 2"
        parts += tree_sql.grown(f"f{t}", source, ["b0", "b1"], _FCAT, _DEPTH, tree_sql.gini, drawn)
        parts.append(f"f{t}l AS MATERIALIZED ({tree_sql.leaves(f'f{t}', _DEPTH)})")
        parts.append(f"f{t}v AS MATERIALIZED (SELECT node, sum(w * y) / sum(w) AS share FROM f{t}l GROUP BY 1)")
    return ", ".join(parts)


_VOTES = " UNION ALL ".join(f"SELECT o_orderkey, y, share FROM f{t}l JOIN f{t}v USING (node) WHERE w = 0" for t in range(_TREES))


@query("orders", f"WITH {_forest_parts()}, votes AS (SELECT o_orderkey, any_value(y) AS y, round(sum(share), 9) AS one, round(sum(1 - share), 9) AS zero FROM ({_VOTES}) GROUP BY 1) SELECT round(avg(((one > zero)::int = y)::int), 6) AS accuracy FROM votes")
def forest_bounded_oob(df):
    return _frame(df, [(_binned_forest(df).oob()[0],)], "accuracy double").withColumn("accuracy", F.round("accuracy", 6))


@query("orders", f"WITH {_forest_parts()} " + " UNION ALL ".join(f"SELECT {t}::int AS tree, round(avg(((share > 0.5)::int = y)::int), 6) AS accuracy FROM f{t}l JOIN f{t}v USING (node) WHERE w = 0" for t in range(_TREES)))
def forest_tree_oob(df):
    return _frame(df, list(enumerate(_binned_forest(df).tree_oob())), "tree int, accuracy double").withColumn("accuracy", F.round("accuracy", 6))


def _drop_sql() -> str:
    """Hits over each tree's left-out rows, as they are and with each feature dealt anew within hash parts."""
    parts, out = [_forest_parts()], []
    for t in range(_TREES):
        part, order = bucket(7, f"'{t}:' || o_orderkey", 16), bucket(8, f"'{t}:' || j || ':0:' || o_orderkey", 1 << 30)
        parts.append(f"f{t}o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o_orderkey) AS place FROM (SELECT o_orderkey, b0, b1, o_orderpriority, y, {part} AS part FROM f{t}l WHERE w = 0))")
        parts.append(f"f{t}d AS (SELECT j, part, row_number() OVER (PARTITION BY j, part ORDER BY {order}, o_orderkey) AS place, b0 AS d0, b1 AS d1, o_orderpriority AS d2 FROM f{t}o, (SELECT unnest(range(3)) AS j))")
        mixed = f"SELECT o.y, d.j, CASE j WHEN 0 THEN d0 ELSE b0 END AS b0, CASE j WHEN 1 THEN d1 ELSE b1 END AS b1, CASE j WHEN 2 THEN d2 ELSE o_orderpriority END AS o_orderpriority FROM f{t}o o JOIN f{t}d d USING (part, place)"
        parts += tree_sql.routed(f"q{t}", f"f{t}", mixed, ["b0", "b1"], _FCAT, _DEPTH)
        kept = f"(SELECT count(*) FILTER ((share > 0.5)::int = y) FROM f{t}l JOIN f{t}v USING (node) WHERE w = 0)"
        name = "['o_totalprice', 'o_custkey', 'o_orderpriority'][j + 1]"
        out.append(f"SELECT {t}::int AS tree, {name} AS feature, count(*) AS n, {kept} AS kept, count(*) FILTER ((share > 0.5)::int = y) AS dropped FROM q{t}r{_DEPTH + 1} JOIN f{t}v USING (node) GROUP BY j")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query("orders", _drop_sql())
def forest_oob_drops(df):
    return _binned_forest(df).permuted_drops().select(F.col("tree").cast("int").alias("tree"), "feature", "n", "kept", "dropped")


@query("orders", f"WITH d AS ({_drop_sql()}), e AS (SELECT feature, (kept - dropped) / n AS x, kept / n AS a FROM d) SELECT feature, round(avg(x), 6) AS importance, round(stddev_pop(x), 6) AS deviation, round(avg(x) / avg(a), 6) AS relative FROM e GROUP BY 1")
def forest_permutation_importance(df):
    found = _binned_forest(df).permutation_importance()
    return found.select("feature", *[r6(F.col(c), c) for c in ("importance", "deviation", "relative")])


@query("orders")
def forest_bounded_search(df):
    rows = df.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    grid = [{"depth": d, "per_node": n, "criterion": c} for d in (1, 3, 5) for n in (1, 3) for c in ("gini", "entropy")]
    best, scores = ensembles.search_binned_forest(rows, "o_orderkey", "y", _FNUM, _FCAT, [0, 1], grid, trees=5, bins=32)
    return _frame(df, [(o["depth"], o["per_node"], o["criterion"], s, o == best) for o, s in scores], "depth int, per_node int, criterion string, oob double, best boolean")


# steps along boosted trees, judged on held-out rows

_STEPS, _ROUNDS, _RATE = [0.25, 0.5, 1.0, 1.5, 2.0], 3, 0.5
_HELD = f"{bucket(3, 'l_orderkey', 100)} < 20"


def _steps_sql(exact: bool) -> str:
    parts = [f"b0 AS MATERIALIZED (SELECT l_extendedprice AS target, l_quantity, l_discount, {_HELD} AS held, (SELECT avg(l_extendedprice) FROM lineitem WHERE NOT ({_HELD})) AS score FROM lineitem)"]
    rows = []
    for k in range(_ROUNDS):
        own = f"SELECT *, CASE WHEN held THEN 0 ELSE 1 END AS w, target - score AS y FROM b{k}"
        parts += tree_sql.grown(f"r{k}", own, ["l_quantity", "l_discount"], [], 2, tree_sql.sse)
        parts.append(f"v{k} AS MATERIALIZED (SELECT target, l_quantity, l_discount, held, score, sum(w * y) OVER (PARTITION BY node) / sum(w) OVER (PARTITION BY node) AS v FROM ({tree_sql.leaves(f'r{k}', 2)}))")
        if exact:
            parts.append(f"a{k} AS MATERIALIZED (SELECT sum((target - score) * v) / sum(v * v) AS a FROM v{k} WHERE NOT held)")
        else:
            parts.append(f"a{k} AS MATERIALIZED (SELECT a FROM v{k}, (SELECT unnest({_STEPS}) AS a) WHERE NOT held GROUP BY a ORDER BY sum((target - score - {_RATE} * a * v) ** 2), a LIMIT 1)")
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT target, l_quantity, l_discount, held, score + {_RATE} * (SELECT a FROM a{k}) * v AS score FROM v{k})")
        rows.append(f"SELECT {k}::int AS round, round((SELECT a FROM a{k}), 6)::double AS step, round(avg((target - score) ** 2) FILTER (NOT held), 2) AS train, round(avg((target - score) ** 2) FILTER (held), 2) AS held FROM b{k + 1}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


def _stepped(df, steps):
    out = hash_bucket(F.col("l_orderkey"), 3, 100) < 20
    m = ensembles.boost(lines(df), "l_extendedprice", ["l_quantity", "l_discount"], rounds=_ROUNDS, rate=_RATE, held_out=out, steps=steps)
    rows = [(k, float(a), t, h) for k, (a, t, h) in enumerate(zip(m.steps, m.history, m.held, strict=True))]
    return _frame(df, rows, "round int, step double, train double, held double").select("round", r6(F.col("step"), "step"), F.round("train", 2).alias("train"), F.round("held", 2).alias("held"))


@query("lineitem", _steps_sql(False))
def boost_step_grid(df):
    return _stepped(df, _STEPS)


@query("lineitem", _steps_sql(True))
def boost_step_exact(df):
    return _stepped(df, "exact")


# pruning and missing values


_PNUM, _PCAT = ["l_quantity", "l_discount"], ["l_linestatus"]


def _prune_sql() -> str:
    """Reduced-error pruning of a tree of two levels: hits of validation rows as leaves, against the best below."""
    own = f"SELECT l_quantity, l_discount, l_linestatus, {_LABEL} AS y, 1 AS w FROM lineitem WHERE l_orderkey % 3 {{}}"
    parts = tree_sql.grown("", own.format("> 0"), _PNUM, _PCAT, 2, tree_sql.gini) + tree_sql.routed("q", "", own.format("= 0"), _PNUM, _PCAT, 2)
    parts.append("said AS (SELECT node, (sum(y) > sum(w - y))::int AS y FROM (SELECT node, y, w FROM t1 UNION ALL SELECT node, y, w FROM t2 UNION ALL SELECT node, y, w FROM t3) GROUP BY 1)")
    rows = " UNION ALL ".join(f"SELECT node, y FROM qr{d} WHERE node >= {1 << d - 1}" for d in (1, 2, 3))
    parts.append(f"h AS MATERIALIZED (SELECT node, count(*) FILTER (r.y = said.y) AS own FROM ({rows}) r JOIN said USING (node) GROUP BY 1)")
    parts.append("b2 AS (SELECT node, coalesce(own, 0) AS own, coalesce((SELECT sum(own) FROM h c WHERE c.node // 2 = s2.node), 0) AS below FROM s2 LEFT JOIN h USING (node))")
    parts.append("k2 AS MATERIALIZED (SELECT node FROM b2 WHERE own < below)")
    parts.append("b1 AS (SELECT (SELECT own FROM h WHERE node = 1) AS own, (SELECT sum(greatest(h.own, coalesce(below, 0))) FROM h LEFT JOIN b2 USING (node) WHERE node IN (2, 3)) AS below)")
    name = f"['{"', '".join(_PNUM + _PCAT)}'][f + 1]"
    return f"""WITH {', '.join(parts)}, cut AS (SELECT own >= below AS cut FROM b1 WHERE EXISTS (SELECT 1 FROM s1))
    SELECT 1::int AS node, CASE WHEN cut THEN NULL ELSE (SELECT {name} FROM s1) END AS feature FROM cut
    UNION ALL SELECT n.node::int, CASE WHEN n.node IN (SELECT node FROM k2) THEN {name} END FROM (SELECT unnest([2, 3]) AS node) n LEFT JOIN s2 ON s2.node = n.node WHERE NOT (SELECT cut FROM cut)
    UNION ALL SELECT (2 * node + c)::int, NULL FROM k2, (SELECT unnest([0, 1]) AS c) WHERE NOT (SELECT cut FROM cut)"""


def _reachable(tree):
    out, stack = [], [1]
    while stack:
        k = stack.pop()
        out.append((k, tree.nodes[k].feature))
        stack += [] if tree.leaf(k) else [2 * k, 2 * k + 1]
    return sorted(out)


def _fitted(df, depth=2):
    return trees.grow(lines(df).where("l_orderkey % 3 > 0"), "y", _PNUM, _PCAT, [0, 1], depth=depth)


@query("lineitem", _prune_sql())
def prune_error(df):
    tree = pruning.pruned(_fitted(df), lines(df).where("l_orderkey % 3 = 0"), "y", _PNUM, _PCAT, [0, 1])
    return _frame(df, _reachable(tree), "node int, feature string")


@query("lineitem")
def prune_rules(df):
    """What each rule leaves of a tree of four levels, by the same validation rows."""
    tree, rows = _fitted(df, 4), lines(df).where("l_orderkey % 3 = 0")
    ways = [(rule, 2.0 if rule == "alpha" else 0.0, leaf) for rule in ("error", "alpha", "twig", "both", "four") for leaf in ("train", "validation", "larger")]
    shapes = [t.shape() for t in pruning.pruned_ways(tree, rows, "y", _PNUM, _PCAT, [0, 1], ways)]
    found = [(rule, leaf, shape["nodes"], shape["leaves"], shape["depth"]) for (rule, _, leaf), shape in zip(ways, shapes, strict=True)]
    return _frame(df, found, "rule string, leaf string, nodes int, leaves int, depth int")


@query("lineitem")
def prune_alpha(df):
    """The cost-complexity path with the validation accuracy of each of its trees."""
    _, path = pruning.best_alpha(_fitted(df, 4), lines(df).where("l_orderkey % 3 = 0"), "y", _PNUM, _PCAT, [0, 1])
    return _frame(df, path, "alpha double, leaves int, accuracy double")


_LACKING = f"SELECT CASE WHEN {bucket(0, 'l_orderkey', 100)} >= 20 THEN l_quantity END AS v, {_LABEL} AS y FROM lineitem"
_FAMILIES = ("shares", "observed", "drop", "larger", "both")


def _families_sql() -> str:
    """The first split by each rule for missing values: threshold, gain and the children's weights."""
    base = f"""WITH h AS ({_LACKING}), a AS (SELECT count(*) AS n, count(*) FILTER (v IS NULL) AS m FROM h), c AS (SELECT v, count(*) AS w, sum(y) AS s FROM h WHERE v IS NOT NULL GROUP BY 1),
    u AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold, sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER () AS aw, sum(s) OVER () AS s1 FROM c WINDOW o AS (ORDER BY v)),
    g AS (SELECT *, {tree_sql.gini('s1', 'aw')} - {tree_sql.gini('ls', 'lw')} - {tree_sql.gini('s1 - ls', 'aw - lw')} AS x FROM u WHERE threshold IS NOT NULL),
    b AS (SELECT * FROM g, a ORDER BY round(x / n, 10) DESC, threshold LIMIT 1)"""
    extra = {"shares": ("m * lw / aw", "m * (aw - lw) / aw"), "drop": ("0", "0"), "larger": ("CASE WHEN 2 * lw >= aw THEN m ELSE 0 END", "CASE WHEN 2 * lw >= aw THEN 0 ELSE m END"), "both": ("m", "m")}
    extra["observed"] = extra["shares"]
    rows = [f"SELECT '{f}' AS missing, threshold, round(x / {'aw' if f == 'observed' else 'n'}, 8) AS gain, round(lw + {extra[f][0]}, 4)::double AS left_weight, round(aw - lw + {extra[f][1]}, 4)::double AS right_weight FROM b" for f in _FAMILIES]
    return f"{base} {' UNION ALL '.join(rows)}"


@query("lineitem", _families_sql())
def missing_families(df):
    holes = prepare.inject_missing(lines(df).select("l_orderkey", "l_quantity", "y"), "l_orderkey", ["l_quantity"], 20)
    found = []
    for f in _FAMILIES:
        t = histogram.grow_binned(holes, "y", ["l_quantity"], [], [0, 1], depth=1, missing=f).nodes
        found.append((f, t[1].threshold, t[1].gain / t[1].weight, t[2].weight, t[3].weight))
    frame = _frame(df, found, "missing string, threshold double, gain double, left_weight double, right_weight double")
    return frame.select("missing", "threshold", F.round("gain", 8).alias("gain"), F.round("left_weight", 4).alias("left_weight"), F.round("right_weight", 4).alias("right_weight"))


_RULES = {"mix": "0.6 * 0.45 + 0.4 * 0.75", "larger": "0.45", "left": "0.45", "node": "0.5", "vote": "0.4"}


@query("orders", f"WITH h AS (SELECT o_orderkey, CASE WHEN {bucket(0, 'o_orderkey', 100)} >= 10 THEN o_totalprice END AS p FROM orders) SELECT o_orderkey, " + ", ".join(f"round(CASE WHEN p IS NULL THEN {v} WHEN p <= 200000 THEN 0.45 ELSE 0.75 END, 6)::double AS by_{k}" for k, v in _RULES.items()) + " FROM h")
def missing_predictions(df):
    """A fixed split at 200,000 and what each rule says of rows without a price."""
    tree = trees.Tree({1: trees.Node([50, 50], 100, "o_totalprice", 200_000.0, None, 0.1, 0.6), 2: trees.Node([33, 27], 60), 3: trees.Node([10, 30], 40)})
    holes = prepare.inject_missing(df.select("o_orderkey", "o_totalprice"), "o_orderkey", ["o_totalprice"], 10)
    return holes.select("o_orderkey", *[r6(tree.value(1, missing=k), f"by_{k}") for k in _RULES])
