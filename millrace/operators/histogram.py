"""Trees from histograms: features are cut in bins once, and a level of any number of trees is one pass over the rows.

Each task counts its rows by tree, node, feature and bin; Spark adds the counts up. Of two siblings only the lighter one
is counted, the other is what remains of their parent. What comes back is bounded by CELLS numbers a pass; a level
with more nodes takes several passes. A row's node is found anew from the tree in each pass, so nothing about rows is
kept between levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ranks import quantiles
from millrace.sources.storage import written

from .trees import Node, Tree

#: Bins of a numeric feature, and values of a categorical one, at most; numbers of a pass that come to the driver.
BINS, CATEGORIES, CELLS = 255, 1_000, 4_000_000


@dataclass(frozen=True)
class Bins:
    """How features become small numbers. Bin 0 is a missing value.

    edges: of a numeric feature, the thresholds between bins 1, 2, ...; points: the values of the bins, where each has
    one. values: of a categorical feature, its values in order.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    points: tuple[np.ndarray | None, ...]
    values: tuple[tuple[str, ...], ...]

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 2 for e in self.edges] + [len(v) + 1 for v in self.values]

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bins of a batch's features; a category that was not there when the bins were made is missing."""
        out = np.zeros((batch.num_rows, len(self.features)), np.int16)
        for k, name in enumerate(self.numeric):
            v = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, k] = np.where(np.isnan(v), 0, np.searchsorted(self.edges[k], v) + 1)
        for k, name in enumerate(self.categorical):
            at = pc.index_in(batch.column(name).cast(pa.string()), value_set=pa.array(self.values[k], pa.string()))
            out[:, len(self.numeric) + k] = pc.fill_null(at, -1).to_numpy(zero_copy_only=False) + 1
        return out


def _few_values(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(f, v) of the values of each column with at most most of them in this partition; a null v for the others."""
    seen: list[np.ndarray | None] | None = None
    for batch in batches:
        seen = [np.zeros(0)] * batch.num_columns if seen is None else seen
        for k, have in enumerate(seen):
            if have is not None:
                v = batch.column(k).to_numpy(zero_copy_only=False)
                have = np.union1d(have, v[~np.isnan(v)])
                seen[k] = have if len(have) <= most else None
    for k, have in enumerate(seen or []):
        v = [None] if have is None else have
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(v, pa.float64())], ["f", "v"])


def fit_bins(df: DataFrame, numeric: list[str], categorical: list[str] = (), bins: int = BINS, exact: bool = True) -> Bins:
    """Bins of a table's features.

    A numeric feature of at most bins values is cut halfway between neighbours, another one at its bins - 1 inner
    quantiles (interpolated if exact, which orders its values in ranges; else from Spark's mergeable sketch). A
    categorical feature with more than CATEGORIES values is an error; the trees of exact splits have no such bound.
    """
    found: dict[int, list[float | None]] = {k: [] for k in range(len(numeric))}
    if numeric:
        plain = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(numeric)])
        each = plain.mapInArrow(lambda batches: _few_values(batches, bins), "f int, v double").distinct()
        kept = each.groupBy("f").agg(F.count_if(F.col("v").isNull()).alias("over"), F.count("v").alias("n"), F.slice(F.sort_array(F.collect_set("v")), 1, bins + 1).alias("vs"))
        for r in kept.collect():  # a row a feature
            found[r.f] = [None] if r.over or r.n > bins else r.vs
    shares = [k / bins for k in range(1, bins)]
    many = [k for k, v in found.items() if v == [None]]
    if exact:
        cuts = {k: quantiles(df, numeric[k], shares) for k in many}
    else:
        sketch = df.agg(*[F.percentile_approx(F.col(numeric[k]).cast("double"), shares, F.lit(100 * bins)).alias(f"q{k}") for k in many]).head() if many else ()
        cuts = dict(zip(many, sketch, strict=True))
    edges, points = [], []
    for k, v in found.items():
        value = None if k in cuts else np.array(v, float)
        edges.append(np.unique(np.array(cuts[k], float)) if k in cuts else (value[1:] + value[:-1]) / 2)
        points.append(value)
    values = []
    for c in categorical:
        rows = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v").limit(CATEGORIES + 1).collect()
        if len(rows) > CATEGORIES:
            raise ValueError(f"{c} has more than {CATEGORIES} values")
        values.append(tuple(sorted(r.v for r in rows)))
    return Bins(tuple(numeric), tuple(categorical), tuple(edges), tuple(points), tuple(values))


def binned(df: DataFrame, bins: Bins, **keep: Column) -> DataFrame:
    """A written table of x (array<short>, the bins) and the named columns."""
    kept = {name: df.select(c.alias(name)).schema[name].dataType.simpleString() for name, c in keep.items()}
    source = df.select(*[F.col(c).cast("double").alias(c) for c in bins.numeric], *[F.col(c).cast("string").alias(c) for c in bins.categorical], *[c.alias(f"_keep_{name}") for name, c in keep.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = bins.codes(batch)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat, *[batch.column(f"_keep_{name}") for name in kept]], ["x", *kept])

    return written(source.mapInArrow(run, ", ".join(["x array<short>", *[f"{name} {kind}" for name, kind in kept.items()]])))


@dataclass
class Grower:
    """One tree that grows: its options, its nodes so far, and the histograms of nodes whose children are to come.

    weight: the place of its weight in the rows' array w, None for 1. allowed: its features, None for all. sums: of weight,
    stats and extra columns by node. missing: what becomes of rows whose value a split lacks:
    shares - they go to both children in the shares of the known weight, and the gain counts for the known share only;
    observed - likewise, but the gain is that of the known rows alone;
    drop - they end at the node; larger - they follow the heavier child; both - they count fully in either child.
    """

    classes: int
    depth: int = 4
    criterion: str = "gini"
    least: float = 1.0
    min_gain: float = 1e-9
    per_node: int | None = None
    seed: int = 0
    weight: int | None = None
    allowed: tuple[int, ...] | None = None
    missing: str = "shares"
    tree: Tree = field(default_factory=Tree)
    cells: dict[int, np.ndarray] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass(frozen=True)
class Route:
    """A tree as arrays by node: feature (-1 at leaves), the last bin that goes left or the one that does, and p_left.

    missing: shares (both children, by p_left), both (each in full) or drop (neither: a row that lacks a value is lost).
    """

    feature: np.ndarray
    cut: np.ndarray
    one: np.ndarray
    p_left: np.ndarray
    missing: str = "shares"

    def ends(self, x: np.ndarray, start: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, node and share of where the rows end that begin at a node; with a missing value they end in several."""
        row, node, share = np.arange(len(x)), np.full(len(x), start, np.int64), np.ones(len(x))
        while True:
            f = self.feature[node]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                return row, node, share
            b, k = x[row[go], f[go]], node[go]
            right = np.where(self.one[k], b != self.cut[k], b > self.cut[k])
            gone = b == 0
            node[go] = 2 * k + np.where(gone, 0, right)
            if gone.any():
                both = go[gone]
                p = self.p_left[k[gone]]
                to_left, to_right = {"shares": (p, 1 - p), "both": (1.0, 1.0), "drop": (0.0, 0.0)}[self.missing]
                extra = (row[both], 2 * k[gone] + 1, share[both] * to_right)
                share[both] *= to_left
                row, node, share = (np.concatenate([a, b]) for a, b in zip((row, node, share), extra, strict=True))
                real = share > 0
                row, node, share = row[real], node[real], share[real]


def route(tree: Tree, bins: Bins, missing: str = "shares") -> Route:
    most = max(tree.nodes, default=1) + 1
    feature, cut, one, p = np.full(most, -1), np.zeros(most, np.int64), np.zeros(most, bool), np.ones(most)
    for k, n in tree.nodes.items():
        if n.feature is not None:
            f = bins.features.index(n.feature)
            feature[k], p[k] = f, n.p_left
            if n.category is not None:
                one[k], cut[k] = True, bins.values[f - len(bins.numeric)].index(n.category) + 1
            else:
                at = bins.points[f]
                cut[k] = np.searchsorted(at, n.threshold, "right") if at is not None else np.searchsorted(bins.edges[f], n.threshold) + 1
    return Route(feature, cut, one, p, missing)


def _impurity(stats: np.ndarray, weight: np.ndarray, criterion: str) -> np.ndarray:
    """As that of the exact splits; stats by the last axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if criterion == "entropy":
            return np.where(stats > 0, -stats * np.log2(stats / weight[..., None]), 0.0).sum(-1)
        if criterion == "misclassification":
            return weight - stats.max(-1)
        if criterion == "quarter":
            return 4 * stats[..., -1] * (weight - stats[..., -1]) / weight
        return -(stats * stats).sum(-1) / weight


def drawn_features(g: Grower, node: int, n: int) -> list[int]:
    """The features that a node may split by: all, or per_node of them by hash."""
    own = list(range(n)) if g.allowed is None else list(g.allowed)
    if g.per_node is None:
        return own
    order = sorted((int(hashlib.md5(f"{g.seed}:{node}:{k}".encode()).hexdigest()[:8], 16) % (1 << 30), k) for k in own)
    return sorted(k for _, k in order[: g.per_node])


def _split(g: Grower, node: int, bins: Bins) -> None:
    """Splits a node by its histogram (all bins of all features by w and stats), if that gains enough, and makes its children."""
    cells, n = g.cells[node], g.tree.nodes[node]
    starts = np.concatenate([[0], np.cumsum(bins.sizes)])
    best: tuple | None = None
    for f in drawn_features(g, node, len(bins.features)):
        known = cells[starts[f] + 1 : starts[f + 1]]
        whole = known.sum(axis=0)
        if f < len(bins.numeric):
            here = np.flatnonzero(known[:, 0] > 1e-12)
            left, at = np.cumsum(known, axis=0)[here[:-1]], here[:-1]
        else:
            at = np.flatnonzero(known[:, 0] > 1e-12)
            left = known[at]
        right = whole - left
        good = (left[:, 0] >= g.least) & (right[:, 0] >= g.least)
        if not good.any():
            continue
        use = slice(1, 1 + g.classes)
        gain = _impurity(whole[None, use], whole[None, 0], g.criterion) - _impurity(left[:, use], left[:, 0], g.criterion) - _impurity(right[:, use], right[:, 0], g.criterion)
        gain = np.where(good, np.round(gain / (whole[0] if g.missing == "observed" else n.weight), 10), -np.inf)
        k = int(gain.argmax())
        if best is None or gain[k] > best[0]:
            following = here[k + 1] if f < len(bins.numeric) else None
            best = (gain[k], f, int(at[k]), following, left[k], whole)
    if best is None or not best[0] > g.min_gain:
        return
    gain, f, at, following, left, whole = best
    n.feature, n.gain, n.p_left = bins.features[f], float(gain) * n.weight, float(left[0] / whole[0])
    if f < len(bins.numeric):
        points = bins.points[f]
        n.threshold = float((points[at] + points[following]) / 2 if points is not None else bins.edges[f][at])
    else:
        n.category = bins.values[f - len(bins.numeric)][at]
    lost, shares = cells[starts[f]], (n.p_left, 1 - n.p_left)
    if g.missing == "larger":
        n.p_left = 1.0 if n.p_left >= 0.5 else 0.0
        shares = (n.p_left, 1 - n.p_left)
    elif g.missing in ("drop", "both"):
        shares = (0.0, 0.0) if g.missing == "drop" else (1.0, 1.0)
    for child, part, share in ((2 * node, left, shares[0]), (2 * node + 1, whole - left, shares[1])):
        g.sums[child] = total = part + share * lost
        g.tree.nodes[child] = Node([float(s) for s in total[1 : 1 + g.classes]], float(total[0]))


def _root(cells: np.ndarray, g: Grower, bins: Bins) -> Node:
    g.sums[1] = total = cells[: bins.sizes[0]].sum(axis=0)  # each row is in one bin of the first feature
    return Node([float(s) for s in total[1 : 1 + g.classes]], float(total[0]))


def _counts(rows: DataFrame, bins: Bins, growers: list[Grower], wanted: list[list[int]], stats, extra: int) -> dict[tuple[int, int], np.ndarray]:
    """(grower, node) -> histogram of each wanted node, from one pass over rows.

    stats(batch, x) gives a matrix of the stats for each grower (or one for all), before they are weighted.
    """
    total, starts = sum(bins.sizes), np.concatenate([[0], np.cumsum(bins.sizes)])
    routes = [route(g.tree, bins, g.missing if g.missing in ("drop", "both") else "shares") for g in growers]
    slots = [{node: s for s, node in enumerate(w)} for w in wanted]
    width = 1 + max(g.classes for g in growers) + extra
    plan = [(r, np.array(sorted(s), np.int64), np.array([s[k] for k in sorted(s)], np.int64), g.weight, [f for f in range(len(bins.features)) if g.allowed is None or f in g.allowed or f == 0]) for r, s, g in zip(routes, slots, growers, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(nodes) * total, width)) for _, nodes, _, _, _ in plan]
        for batch in batches:
            x = _matrix(batch.column("x"), batch.num_rows, np.int16)
            if not len(x):
                continue
            own = stats(batch, x)
            w = _matrix(batch.column("w"), batch.num_rows, np.float64) if "w" in batch.schema.names else None
            for k, (way, nodes, slot, place, features) in enumerate(plan):
                if not len(nodes):
                    continue
                row, node, share = way.ends(x)
                at = np.searchsorted(nodes, node).clip(max=len(nodes) - 1)
                here = nodes[at] == node
                if place is not None:
                    share = share * w[row, place]
                    here &= share > 0
                row, share, at = row[here], share[here], slot[at[here]]
                s = own[k] if isinstance(own, list) else own
                values = [share, *[share * s[row, c] for c in range(s.shape[1])]]
                table = sums[k].reshape(len(nodes), total, width)
                for f in features:
                    size = starts[f + 1] - starts[f]
                    cell = at * size + x[row, f]
                    for c, v in enumerate(values):
                        table[:, starts[f] : starts[f + 1], c] += np.bincount(cell, v, len(nodes) * size).reshape(-1, size)
        for k, table in enumerate(sums):
            cell = np.flatnonzero(table.any(axis=1))
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), *[pa.array(table[cell, c]) for c in range(width)]], ["g", "cell", *[f"s{c}" for c in range(width)]])

    schema = ", ".join(["g int", "cell long", *[f"s{c} double" for c in range(width)]])
    summed = rows.mapInArrow(run, schema).groupBy("g", "cell").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(width)]).toArrow()  # CELLS rows at most
    g, cell = summed["g"].to_numpy(), summed["cell"].to_numpy()
    out = {(k, node): np.zeros((total, width)) for k, w in enumerate(wanted) for node in w}
    for k, w in enumerate(wanted):
        mine = g == k
        table = np.zeros((len(w) * total, width))
        for c in range(width):
            table[cell[mine], c] = summed[f"s{c}"].to_numpy()[mine]
        for node, s in slots[k].items():
            out[k, node] = table[s * total : (s + 1) * total]
    return out


def _matrix(column: pa.Array, n: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 1), kind)


def grow_all(rows: DataFrame, bins: Bins, growers: list[Grower], stats, extra: int = 0, cells: int = CELLS) -> None:
    """Grows all trees together, level by level, on a table of binned rows (x, and w where a grower has a weight).

    stats(batch, x) is a matrix of each row's class indicators or target, with extra columns that are summed as well; a
    list of matrices gives each grower its own. The histograms of a level are kept for the next one's siblings while
    they have at most cells numbers; beyond that, both siblings are counted.
    """
    width = 1 + max(g.classes for g in growers) + extra
    one = sum(bins.sizes) * width
    pairs = [[(k, 1)] for k in range(len(growers))]
    for d in range(max(g.depth for g in growers) + 1):
        keep, below = sum(map(len, pairs)) * one <= cells, []
        lot = max(1, cells // (2 * one))
        for low in range(0, len(pairs), lot):
            wanted: list[list[int]] = [[] for _ in growers]
            for pair in pairs[low : low + lot]:
                for k, node in pair:
                    # of two siblings the lighter one is counted where the parent's histogram is at hand and the sum of both
                    if node == 1 or node // 2 not in growers[k].cells or growers[k].missing in ("drop", "both") or (node % 2 == 0) == _lighter(growers[k], node & ~1):
                        wanted[k].append(node)
            counted = _counts(rows, bins, growers, wanted, stats, extra)
            for k, node in (x for pair in pairs[low : low + lot] for x in pair):
                g = growers[k]
                own = counted.get((k, node))
                g.cells[node] = g.cells[node // 2] - counted[k, node ^ 1] if own is None else own
                if node == 1:
                    g.tree.nodes[1] = _root(g.cells[1], g, bins)
                if g.depth > d and g.tree.nodes[node].weight > 0:
                    _split(g, node, bins)
                    if g.tree.nodes[node].feature is not None and g.depth > d + 1:
                        below.append([(k, 2 * node), (k, 2 * node + 1)])
                if not keep:
                    del g.cells[node]
        for g in growers:  # the level above is of no more use
            g.cells = {node: c for node, c in g.cells.items() if node >> d}
        pairs = below
        if not pairs:
            break


def _lighter(g: Grower, left: int) -> bool:
    return g.tree.nodes[left].weight <= g.tree.nodes[left + 1].weight


def grow_binned(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), classes: list | None = None, bins: int = BINS, exact: bool = True, **options) -> Tree:
    """A tree with bounded thresholds: of a classification for given classes, else of a regression. Null labels are left out."""
    df = df.where(F.col(label).isNotNull())
    cut = fit_bins(df, list(numeric), list(categorical), bins, exact)
    y = label_codes(label, classes) if classes else F.col(label).cast("double")
    rows = binned(df, cut, y=y)
    g = Grower(len(classes) if classes else 1, criterion=options.pop("criterion", "gini" if classes else "sse"), **options)
    grow_all(rows, cut, [g], indicators(len(classes)) if classes else target)
    return finished(g.tree, g.classes)


def label_codes(label: str, classes: list) -> Column:
    """The label's place among the classes, -1 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1, F.lit(-1))


def indicators(n: int):
    """Stats of a table with y, the class's place."""

    def stats(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        return (batch.column("y").to_numpy(zero_copy_only=False)[:, None] == np.arange(n)).astype(float)

    return stats


def target(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
    return batch.column("y").to_numpy(zero_copy_only=False).astype(float)[:, None]


def finished(tree: Tree, classes: int) -> Tree:
    tree.nodes = tree.nodes or {1: Node([0.0] * classes, 0.0)}
    return tree


def predictions(trees: list[Tree], bins: Bins, classes: int):
    """A function of binned rows x: for each tree, its shares by row and class."""
    routes = [(route(t, bins), _values(t, classes)) for t in trees]

    def run(x: np.ndarray) -> list[np.ndarray]:
        out = []
        for way, value in routes:
            row, node, share = way.ends(x)
            out.append(np.stack([np.bincount(row, share * value[node, c], len(x)) for c in range(classes)], axis=1))
        return out

    return run


def _values(tree: Tree, classes: int) -> np.ndarray:
    out = np.zeros((max(tree.nodes, default=1) + 1, classes))
    for k, n in tree.nodes.items():
        out[k] = n.values()
    return out
