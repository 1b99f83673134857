"""SQL that grows the same trees as millrace.operators.trees, unrolled level by level, for the comparison of results."""

from __future__ import annotations


def gini(s: str, w: str) -> str:
    return f"(-((({w}) - ({s})) * (({w}) - ({s})) + ({s}) * ({s}))::double / ({w}))"


def sse(s: str, w: str) -> str:
    return f"(-(({s}) * ({s}))::double / ({w}))"


def grown(p: str, source: str, numeric: list[str], categorical: list[str], depth: int, impurity, drawn: str | None = None) -> list[str]:
    """Common table expressions: {p}t1, {p}t2, ... rows by level with their node, {p}s1, ... the splits of a level.

    source has the features, y and a weight w. drawn: SQL of (node, f), the features that a node may split by, with
    {rows} for the level's rows.
    """
    features = [*numeric, *categorical]
    out = [f"{p}t1 AS MATERIALIZED (SELECT *, 1 AS node FROM ({source}))"]
    for d in range(1, depth + 1):
        rows = f"{p}t{d}"
        each = [f"SELECT node, w, y, {k} AS f, {c + '::double' if c in numeric else 'NULL::double'} AS v, {'NULL::varchar' if c in numeric else c} AS c FROM {rows} WHERE w > 0" for k, c in enumerate(features)]
        semi = f" SEMI JOIN ({drawn.format(rows=rows)}) USING (node, f)" if drawn else ""
        own = f"f >= {len(numeric)}"
        known, left, right = impurity("s1", "aw"), impurity("ls", "lw"), impurity("s1 - ls", "aw - lw")
        goes = " ".join(f"WHEN {k} THEN {c} <= threshold" if c in numeric else f"WHEN {k} THEN {c} = category" for k, c in enumerate(features))
        out += [
            f"{p}c{d} AS MATERIALIZED (SELECT node, f, v, c, sum(w) AS w, sum(w * y) AS s FROM ({' UNION ALL '.join(each)}){semi} GROUP BY ALL)",
            f"{p}n{d} AS MATERIALIZED (SELECT node, sum(w) AS all_w FROM {rows} GROUP BY 1)",
            f"{p}u{d} AS (SELECT node, f, (v + lead(v) OVER o) / 2 AS threshold, c AS category, CASE WHEN {own} THEN w ELSE sum(w) OVER o END AS lw, CASE WHEN {own} THEN s ELSE sum(s) OVER o END AS ls, sum(w) OVER (PARTITION BY node, f) AS aw, sum(s) OVER (PARTITION BY node, f) AS s1 FROM {p}c{d} WINDOW o AS (PARTITION BY node, f ORDER BY v))",
            f"{p}g{d} AS (SELECT node, f, threshold, category, round(({known} - {left} - {right}) / all_w, 10) AS gain FROM {p}u{d} JOIN {p}n{d} USING (node) WHERE (threshold IS NOT NULL OR category IS NOT NULL) AND lw >= 1 AND aw - lw >= 1)",
            f"{p}s{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, threshold NULLS FIRST, category NULLS FIRST) AS place FROM {p}g{d}) WHERE place = 1 AND gain > 1e-9)",
            f"{p}t{d + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node), 2 * t.node + CASE WHEN CASE s.f {goes} END THEN 0 ELSE 1 END AS node FROM {rows} t JOIN {p}s{d} s ON t.node = s.node)",
        ]
    return out


def routed(q: str, p: str, source: str, numeric: list[str], categorical: list[str], depth: int) -> list[str]:
    """Common table expressions {q}r1, ...: other rows with these features on their way through the tree {p}; the last has their node."""
    features = [*numeric, *categorical]
    goes = " ".join(f"WHEN {k} THEN {c} <= threshold" if c in numeric else f"WHEN {k} THEN {c} = category" for k, c in enumerate(features))
    out = [f"{q}r1 AS (SELECT *, 1 AS node FROM ({source}))"]
    for d in range(1, depth + 1):
        out.append(f"{q}r{d + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN CASE s.f {goes} END THEN 0 ELSE 1 END END AS node FROM {q}r{d} r LEFT JOIN {p}s{d} s ON r.node = s.node)")
    return out


def leaves(p: str, depth: int) -> str:
    """All rows with the node that they end in."""
    done = [f"SELECT * FROM {p}t{d} WHERE node NOT IN (SELECT node FROM {p}s{d})" for d in range(1, depth + 1)]
    return " UNION ALL ".join([*done, f"SELECT * FROM {p}t{depth + 1}"])


def nodes(p: str, depth: int, features: list[str]) -> str:
    """(node, feature, threshold, category, weight, gain) of all nodes; gain is null at leaves."""
    name = f"['{"', '".join(features)}'][s.f + 1]"
    levels = [f"SELECT node, {name} AS feature, threshold, category, all_w AS weight, gain FROM {p}n{d} LEFT JOIN {p}s{d} s USING (node)" for d in range(1, depth + 1)]
    last = f"SELECT node, NULL, NULL, NULL, sum(w), NULL FROM {p}t{depth + 1} GROUP BY 1"
    return " UNION ALL ".join([*levels, last])


def boosted(start: str, source: str, numeric: list[str], categorical: list[str], rounds: int, rate: float, logistic: bool, depth: int = 2) -> list[str]:
    """Common table expressions b0, b1, ...: source's rows (target and features) with their score after each round."""
    kept = ", ".join(["target", *numeric, *categorical])
    out = [f"b0 AS MATERIALIZED (SELECT *, ({start}) AS score FROM ({source}))"]
    for k in range(rounds):
        said = "(1 / (1 + exp(-score)))" if logistic else "score"
        own = f"SELECT *, 1 AS w, target - {said} AS y, {said} * (1 - {said}) AS h FROM b{k}"
        leaf = "sum(y) OVER n / greatest(sum(h) OVER n, 1e-9)" if logistic else "avg(y) OVER n"
        out += grown(f"r{k}", own, numeric, categorical, depth, sse)
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT {kept}, score + {rate} * ({leaf}) AS score FROM ({leaves(f'r{k}', depth)}) WINDOW n AS (PARTITION BY node))")
    return out
