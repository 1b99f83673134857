"""Pruning on validation rows, bottom up: a level of the tree is one pass, in which Spark counts hits with and without it.

Rows are binned and equal ones counted once. A node's rows are judged by its subtree as it is after the levels below, by the node as a leaf and by either child's
subtree alone; a row with a missing value counts in shares. What comes back is a few class tables for each node of the
level. Choices are made on the driver's node table.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.storage import written

from .ensembles import _added
from .histogram import CATEGORIES, Bins, _matrix, _values, binned, label_codes, route
from .trees import Node, Tree, cost_complexity_path


def bins_of(tree: Tree, df: DataFrame, numeric: list[str], categorical: list[str]) -> Bins:
    """Bins that are cut where the tree cuts, so that rows go where their values say; all categories of df have one."""
    used = [n for n in tree.nodes.values() if n.feature is not None]
    edges = tuple(np.array(sorted({n.threshold for n in used if n.feature == c}), float) for c in numeric)
    values = []
    for c in categorical:
        rows = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().limit(CATEGORIES + 1).collect()
        if len(rows) > CATEGORIES:
            raise ValueError(f"{c} has more than {CATEGORIES} values")
        values.append(tuple(sorted({r.v for r in rows} | {n.category for n in used if n.feature == c})))
    return Bins(tuple(numeric), tuple(categorical), edges, (None,) * len(numeric), tuple(values))


def _counted(tree: Tree, df: DataFrame, label: str, numeric: list[str], categorical: list[str], classes: list) -> tuple[Bins, DataFrame]:
    """The bins and a written table of x, y and n, the number of labelled rows of df with these bins and class."""
    cut = bins_of(tree, df, numeric, categorical)
    rows = binned(df.where(F.col(label).isNotNull()), cut, y=label_codes(label, classes))
    return cut, written(rows.groupBy("x", "y").agg(F.count("*").alias("n")))


def _level_counts(rows: DataFrame, bins: Bins, levels: list[tuple[Tree, list[int]]], classes: int, missing: str) -> list[dict[int, np.ndarray]]:
    """For each tree and its nodes: node -> weights by (subtree, left, right; real class; said class), from one pass over the counted rows."""
    ways = []
    for tree, nodes in levels:
        whole = route(tree, bins, missing)
        feature = whole.feature.copy()
        feature[nodes] = -1  # rows stop at the level
        ways.append((nodes, whole, type(whole)(feature, whole.cut, whole.one, whole.p_left, missing), _values(tree, classes)))
    size = 3 * classes * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(j, k): np.zeros((3, classes, classes)) for j, way in enumerate(ways) for k in way[0]}
        for batch in batches:
            x, y, times = _matrix(batch.column("x"), batch.num_rows, np.int16), batch.column("y").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            for j, (nodes, whole, stop, value) in enumerate(ways):
                row, node, share = stop.ends(x)
                for k in nodes:
                    here = node == k
                    mine = x[row[here]]
                    if not len(mine):
                        continue
                    real, weight = y[row[here]], share[here] * times[row[here]]
                    good = real >= 0
                    for at, start in enumerate((k, 2 * k, 2 * k + 1)):
                        r, n, s = whole.ends(mine, start)
                        p = np.stack([np.bincount(r, s * value[n, c], len(mine)) for c in range(classes)], axis=1)
                        said = np.round(p, 12).argmax(axis=1)
                        total[j, k][at] += np.bincount(real[good] * classes + said[good], weight[good], classes * classes).reshape(classes, classes)
        for (j, k), t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([k], pa.int64()), pa.array([t.ravel().tolist()], pa.list_(pa.float64()))], ["way", "node", "t"])

    sums = [F.sum(F.col("t")[c]).alias(f"c{c}") for c in range(size)]
    found = rows.mapInArrow(run, "way int, node long, t array<double>").groupBy("way", "node").agg(*sums).collect()  # the levels' nodes
    out = [{k: np.zeros((3, classes, classes)) for k in nodes} for _, nodes in levels]
    for r in found:
        out[r.way][r.node] = np.array([r[f"c{c}"] for c in range(size)]).reshape(3, classes, classes)
    return out


def _moved(tree: Tree, old: int, new: int) -> None:
    """The subtree at old takes the place of the one at new, which is its parent."""
    below, stack = {}, [(old, new)]
    while stack:
        a, b = stack.pop()
        below[b] = tree.nodes[a]
        if not tree.leaf(a):
            stack += [(2 * a, 2 * b), (2 * a + 1, 2 * b + 1)]
    stack = [new]
    while stack:
        k = stack.pop()
        if not tree.leaf(k):
            stack += [2 * k, 2 * k + 1]
        del tree.nodes[k]
    tree.nodes |= below


def _macro_f1(t: np.ndarray) -> float:
    """Of a table of real and said classes; an undefined ratio counts as 0."""
    hits, real, said = np.diag(t), t.sum(axis=1), t.sum(axis=0)
    return float(np.mean([2 * h / (r + s) if r + s else 0.0 for h, r, s in zip(hits, real, said, strict=True)]))


def pruned(tree: Tree, df: DataFrame, label: str, numeric: list[str], categorical: list[str], classes: list, rule: str = "error", alpha: float = 0.0, leaf: str = "train", missing: str = "shares") -> Tree:
    """A pruned copy of a classification tree, by the labelled rows of df.

    rule: error - a subtree goes where it has no more hits than its root as a leaf; alpha - likewise if it has at most
    alpha more; twig - error, but only nodes whose children are leaves; both - neither accuracy nor macro F1 of the whole tree may
    fall; four - the best of the subtree, the leaf, the left and the right child's subtree, in this order.
    leaf: what a new leaf says: train (its own classes), validation (those of the rows that reach it; its own if none
    does) or larger (those of its heavier child). missing: rows whose value a split lacks go to both children in
    shares, to both in full, or are left out (shares, both, drop).
    """
    return pruned_ways(tree, df, label, numeric, categorical, classes, [(rule, alpha, leaf)], missing)[0]


def pruned_ways(tree: Tree, df: DataFrame, label: str, numeric: list[str], categorical: list[str], classes: list, ways: list[tuple[str, float, str]], missing: str = "shares") -> list[Tree]:
    """A copy pruned in each way (rule, alpha, leaf): df is read once, and a level of all copies is one pass over its counted rows."""
    trees, n = [copy.deepcopy(tree) for _ in ways], len(classes)
    cut, rows = _counted(tree, df, label, numeric, categorical, classes)
    inner = sorted((k for k in tree.nodes if not tree.leaf(k)), reverse=True)
    totals: list[np.ndarray] = []
    for depth in sorted({k.bit_length() for k in inner}, reverse=True):
        level = [k for k in inner if k.bit_length() == depth]
        levels = [(t, level) for t in trees] + ([] if totals else [(tree, [1])])
        found = _level_counts(rows, cut, levels, n, missing)
        totals = totals or [found[-1][1][0]] * len(ways)
        for j, (rule, alpha, leaf) in enumerate(ways):
            totals[j] = _pruned_level(trees[j], level, found[j], totals[j], rule, alpha, leaf)
    return trees


def _pruned_level(tree: Tree, level: list[int], counts: dict[int, np.ndarray], total: np.ndarray, rule: str, alpha: float, leaf: str) -> np.ndarray:
    """Prunes the level's nodes by their tables; returns the whole tree's table, kept for the rule both."""
    n = len(total)
    for k in level:
        if rule == "twig" and not (tree.leaf(2 * k) and tree.leaf(2 * k + 1)):
            continue
        t = counts[k]
        real, node = t[0].sum(axis=1), tree.nodes[k]
        stats, weight = node.stats, node.weight
        if leaf == "validation" and real.sum():
            stats, weight = [float(v) for v in real], float(real.sum())
        elif leaf == "larger":
            child = max((tree.nodes[2 * k], tree.nodes[2 * k + 1]), key=lambda c: c.weight)
            stats, weight = child.stats, child.weight
        said = Node(stats, weight).label()
        hits = [np.trace(t[0]), real[said], np.trace(t[1]), np.trace(t[2])]
        take = 0
        if rule == "four":
            take = int(np.argmax(np.round(hits, 9)))
        elif rule == "both":
            as_leaf = np.zeros((n, n))
            as_leaf[:, said] = real
            after = total - t[0] + as_leaf
            if round(np.trace(after) - np.trace(total), 9) >= 0 and round(_macro_f1(after) - _macro_f1(total), 12) >= 0:
                take, total = 1, after
        elif round(hits[1] + alpha - hits[0], 9) >= 0:
            take = 1
        if take == 1:
            node.feature, node.stats, node.weight = None, list(stats), weight
        elif take > 1:
            _moved(tree, 2 * k + take - 2, k)
    return total


def reestimated(tree: Tree, df: DataFrame, label: str, numeric: list[str], categorical: list[str], classes: list) -> Tree:
    """A copy whose leaves have the classes of df's rows, in shares; leaves without any keep their own."""
    tree, n = copy.deepcopy(tree), len(classes)
    cut = bins_of(tree, df, numeric, categorical)
    rows = binned(df.where(F.col(label).isNotNull()), cut, y=label_codes(label, classes))
    way, leaves = route(tree, cut), sorted(k for k in tree.nodes if tree.leaf(k))
    place = {k: j for j, k in enumerate(leaves)}

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        row, node, share = way.ends(_matrix(batch.column("x"), batch.num_rows, np.int16))
        real = batch.column("y").to_numpy(zero_copy_only=False)[row]
        at, good = np.array([place[k] for k in node.tolist()]), real >= 0
        return np.bincount(at[good] * n + real[good], share[good], len(leaves) * n)

    found = _added(rows, len(leaves) * n, numbers).reshape(len(leaves), n)
    for k, counts in zip(leaves, found, strict=True):
        if counts.sum():
            tree.nodes[k].stats, tree.nodes[k].weight = [float(c) for c in counts], float(counts.sum())
    return tree


def best_alpha(tree: Tree, df: DataFrame, label: str, numeric: list[str], categorical: list[str], classes: list) -> tuple[Tree, list[tuple[float, int, float]]]:
    """The subtree of the cost-complexity path with the best accuracy on df, the smallest of equal ones, and the path.

    The path has (alpha, leaves, accuracy), from the whole tree (alpha 0); all of its trees are judged in one pass.
    """
    cut = bins_of(tree, df, numeric, categorical)
    rows = binned(df.where(F.col(label).isNotNull()), cut, y=label_codes(label, classes))
    path = cost_complexity_path(copy.deepcopy(tree))
    steps = [(0.0, copy.deepcopy(tree))]
    for alpha, leaves in path:
        now = copy.deepcopy(steps[-1][1])
        while now.shape()["leaves"] > leaves:  # the weakest link again, as the path has cut it
            _cut_weakest(now)
        steps.append((alpha, now))
    ways = [(route(t, cut), _values(t, len(classes))) for _, t in steps]

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch.column("x"), batch.num_rows, np.int16), batch.column("y").to_numpy(zero_copy_only=False)
        out = [float(len(y))]
        for way, value in ways:
            row, node, share = way.ends(x)
            p = np.stack([np.bincount(row, share * value[node, c], len(x)) for c in range(len(classes))], axis=1)
            out.append(float((np.round(p, 12).argmax(axis=1) == y).sum()))
        return np.array(out)

    found = _added(rows, 1 + len(ways), numbers)
    scores = [float(h / found[0]) if found[0] else 0.0 for h in found[1:]]
    best = max(range(len(steps)), key=lambda k: (round(scores[k], 12), k))
    return steps[best][1], [(a, t.shape()["leaves"], s) for (a, t), s in zip(steps, scores, strict=True)]


def _cut_weakest(tree: Tree) -> None:
    """Cuts the link of the smallest cost a leaf, as cost_complexity_path does."""
    total = tree.nodes[1].weight or 1.0

    def below(k: int) -> tuple[float, int]:
        n = tree.nodes[k]
        if tree.leaf(k):
            return (n.weight - max(n.stats)) / total, 1
        a, b = below(2 * k), below(2 * k + 1)
        return a[0] + b[0], a[1] + b[1]

    links, stack = [], [1]
    while stack:
        k = stack.pop()
        if not tree.leaf(k):
            stack += [2 * k, 2 * k + 1]
            cost, leaves = below(k)
            n = tree.nodes[k]
            links.append((((n.weight - max(n.stats)) / total - cost) / (leaves - 1), k))
    tree.prune(min(links)[1])
