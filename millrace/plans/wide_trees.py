"""Registered queries of trees with any number of children. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import nary, prepare

from .catalog import bucket, query, r6

_HOLED = f"SELECT o_orderkey, CASE WHEN {bucket(0, 'o_orderkey', 100)} >= 10 THEN o_totalprice END AS v, CASE WHEN {bucket(1, 'o_orderkey', 100)} >= 10 THEN o_orderpriority END AS c, (o_orderstatus = 'F')::int AS y, o_orderkey % 4 = 0 AS out FROM orders"


def _rows(df):
    holes = prepare.inject_missing(df.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), "o_orderkey", ["o_totalprice", "o_orderpriority"], 10)
    return holes.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))


def _gini(s: str, w: str) -> str:
    return f"(-((({w}) - ({s})) * (({w}) - ({s})) + ({s}) * ({s}))::double / ({w}))"


def _tree_sql(source: str, depth: int) -> list[str]:
    """Common table expressions of the tree: t1, t2, ... rows in shares by node, s1, ... splits, k1, ... children, n1, ... nodes."""
    out = [f"t1 AS MATERIALIZED (SELECT *, '' AS node, 1.0::double AS w FROM ({source}))"]
    for d in range(1, depth + 1):
        filled = lambda s, w: (f"({s} + {w} / k_w * (all_s - k_s))", f"({w} + {w} / k_w * (all_w - k_w))")
        left, right, one = filled("l_s", "l_w"), filled("(k_s - l_s)", "(k_w - l_w)"), filled("s", "w")
        out += [
            f"n{d} AS MATERIALIZED (SELECT node, sum(w) AS all_w, sum(w * y) AS all_s FROM t{d} GROUP BY 1)",
            f"o{d} AS (SELECT * FROM n{d} WHERE all_w >= 2 AND greatest(all_s, all_w - all_s) < all_w)",
            f"a{d} AS (SELECT node, v, sum(w) AS w, sum(w * y) AS s FROM t{d} WHERE v IS NOT NULL GROUP BY 1, 2)",
            f"u{d} AS (SELECT node, (v + lead(v) OVER o) / 2 AS threshold, sum(w) OVER o AS l_w, sum(s) OVER o AS l_s, sum(w) OVER (PARTITION BY node) AS k_w, sum(s) OVER (PARTITION BY node) AS k_s FROM a{d} WINDOW o AS (PARTITION BY node ORDER BY v))",
            f"b{d} AS (SELECT node, c, sum(w) AS w, sum(w * y) AS s FROM t{d} WHERE c IS NOT NULL GROUP BY 1, 2)",
            f"e{d} AS (SELECT *, sum(w) OVER (PARTITION BY node) AS k_w, sum(s) OVER (PARTITION BY node) AS k_s FROM b{d})",
            f"g{d} AS (SELECT node, 0 AS f, threshold, round(({_gini('all_s', 'all_w')} - {_gini(*left)} - {_gini(*right)}) / all_w, 10) AS gain FROM u{d} JOIN o{d} USING (node) WHERE threshold IS NOT NULL UNION ALL SELECT node, 1, NULL, round((any_value({_gini('all_s', 'all_w')}) - sum({_gini(*one)})) / any_value(all_w), 10) FROM e{d} JOIN o{d} USING (node) GROUP BY node HAVING count(*) > 1)",
            f"s{d} AS MATERIALIZED (SELECT node, f, threshold, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, threshold) AS place FROM g{d}) WHERE place = 1)",
            f"m{d} AS MATERIALIZED (SELECT t.*, CASE f WHEN 0 THEN CASE WHEN v <= threshold THEN '<=' WHEN v IS NOT NULL THEN '>' END ELSE '=' || c END AS branch FROM t{d} t JOIN s{d} s ON t.node = s.node)",
            f"k{d} AS MATERIALIZED (SELECT node, branch, sum(w) / sum(sum(w)) OVER (PARTITION BY node) AS share FROM m{d} WHERE branch IS NOT NULL GROUP BY 1, 2)",
            f"t{d + 1} AS MATERIALIZED (SELECT m.* EXCLUDE (node, w, branch), m.node || '/' || k.branch AS node, m.w * CASE WHEN m.branch IS NULL THEN k.share ELSE 1 END AS w FROM m{d} m JOIN k{d} k ON m.node = k.node AND (m.branch IS NULL OR m.branch = k.branch))",
        ]
    out.append(f"n{depth + 1} AS MATERIALIZED (SELECT node, sum(w) AS all_w, sum(w * y) AS all_s FROM t{depth + 1} GROUP BY 1)")
    return out


def _ended_sql(source: str, depth: int) -> list[str]:
    """Common table expressions z: other rows with the node and share in which they end; a value that was not there stays."""
    out, done = [f"r1 AS MATERIALIZED (SELECT *, '' AS node, 1.0::double AS w FROM ({source}))"], []
    for d in range(1, depth + 1):
        out.append(f"q{d} AS MATERIALIZED (SELECT r.*, s.f IS NOT NULL AS split, CASE f WHEN 0 THEN CASE WHEN v <= threshold THEN '<=' WHEN v IS NOT NULL THEN '>' END WHEN 1 THEN '=' || c END AS branch FROM r{d} r LEFT JOIN s{d} s ON r.node = s.node)")
        out.append(f"r{d + 1} AS MATERIALIZED (SELECT q.* EXCLUDE (node, w, branch, split), q.node || '/' || k.branch AS node, q.w * CASE WHEN q.branch IS NULL THEN k.share ELSE 1 END AS w FROM q{d} q JOIN k{d} k ON q.node = k.node AND (q.branch IS NULL OR q.branch = k.branch) WHERE split)")
        done.append(f"SELECT o_orderkey, y, node, w FROM q{d} q WHERE NOT split OR branch IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k{d} k WHERE k.node = q.node AND k.branch = q.branch)")
    out.append(f"z AS MATERIALIZED ({' UNION ALL '.join([*done, f'SELECT o_orderkey, y, node, w FROM r{depth + 1}'])})")
    return out


_ALL = " UNION ALL ".join(f"SELECT * FROM n{d}" for d in (1, 2, 3))


def _grown(df, **more):
    return nary.grow_nary(df, "y", ["o_totalprice"], ["o_orderpriority"], [0, 1], **{"depth": 2} | more)


@query("orders", f"WITH {', '.join(_tree_sql(_HOLED, 2))} SELECT (SELECT count(*) FROM ({_ALL})) AS nodes, (SELECT count(*) FROM ({_ALL})) - (SELECT count(*) FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)) AS leaves, 2::int AS depth, (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY node)) AS widest")
def nary_shape(df):
    return _grown(_rows(df)).shape()


_FIT, _OUT = f"SELECT * FROM ({_HOLED}) WHERE NOT out", f"SELECT * FROM ({_HOLED}) WHERE out"


@query("orders", f"WITH {', '.join(_tree_sql(_FIT, 2) + _ended_sql(_OUT, 2))} SELECT o_orderkey, round(sum(z.w * all_s / all_w), 6) AS share FROM z JOIN ({_ALL}) USING (node) GROUP BY 1")
def nary_shares(df):
    """Fitted on three orders in four, the others' shares; rows with missing values in all branches."""
    rows = _rows(df)
    tree = _grown(rows.where("o_orderkey % 4 <> 0"))
    return tree.shares(rows.where("o_orderkey % 4 = 0"), "o_orderkey").select("o_orderkey", r6(F.col("shares")[1], "share"))


_HITS = "h AS (SELECT node, sum(h.w * ((h.y = (all_s > all_w - all_s)::int)::int)) AS own FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) h JOIN (" + _ALL + ") n USING (node) GROUP BY 1)"


@query("orders", f"""WITH {', '.join(_tree_sql(_FIT, 2) + _ended_sql(_OUT, 2))}, {_HITS},
    x2 AS (SELECT s2.node, coalesce(h.own, 0) AS own, coalesce((SELECT sum(c.own) FROM k2 JOIN h c ON c.node = k2.node || '/' || k2.branch WHERE k2.node = s2.node), 0) AS below FROM s2 LEFT JOIN h USING (node)),
    p2 AS (SELECT n2.node, CASE WHEN x2.node IS NULL OR round(x2.own, 9) >= round(x2.below, 9) THEN coalesce(h.own, 0) ELSE x2.below END AS best, x2.node IS NOT NULL AND round(x2.own, 9) < round(x2.below, 9) AS split FROM n2 LEFT JOIN x2 USING (node) LEFT JOIN h USING (node)),
    top AS (SELECT round((SELECT own FROM h WHERE node = ''), 9) >= round((SELECT sum(best) FROM p2), 9) AS cut)
    SELECT CASE WHEN cut THEN 1 ELSE 1 + (SELECT count(*) FROM n2) + (SELECT count(*) FROM k2 JOIN p2 USING (node) WHERE split) END::bigint AS nodes, CASE WHEN cut THEN 1 ELSE (SELECT count(*) FROM p2 WHERE NOT split) + (SELECT count(*) FROM k2 JOIN p2 USING (node) WHERE split) END::bigint AS leaves FROM top""")
def nary_pruned(df):
    """Reduced-error pruning of the same tree by the other orders."""
    rows = _rows(df)
    tree = _grown(rows.where("o_orderkey % 4 <> 0"))
    return tree.pruned(rows.where("o_orderkey % 4 = 0"), "o_orderkey", "y").shape().select("nodes", "leaves")
