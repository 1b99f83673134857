"""Decision trees grown level by level on exact splits, and forests of them.

A level is one aggregation: rows are counted by node, feature and value, cumulated over ranges of the values, and the
best split of each node comes back. Rows are written with their node for the next level; the tree is a small table of
nodes on the driver. Trees with bounded thresholds, of which many grow in one pass, are in the histogram module.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.expressions import hash_bucket
from millrace.functions.ranks import running_sums_within
from millrace.sources.storage import written

from .prepare import poisson_times


@dataclass
class Node:
    """stats: weight by class, or [sum of w * y]. A missing value goes left with the share p_left."""

    stats: list[float]
    weight: float
    feature: str | None = None
    threshold: float | None = None
    category: str | None = None
    gain: float = 0.0
    p_left: float = 1.0

    def values(self) -> list[float]:
        return [s / self.weight if self.weight else 0.0 for s in self.stats]

    def label(self) -> int:
        """The place of the heaviest class, the first of equal ones."""
        return max(range(len(self.stats)), key=self.stats.__getitem__)


@dataclass
class Tree:
    """Node 1 is the root, node k's children are 2k and 2k + 1."""

    nodes: dict[int, Node] = field(default_factory=dict)

    def leaf(self, k: int) -> bool:
        return self.nodes[k].feature is None

    def value(self, which: int = 0, k: int = 1, missing: str = "mix") -> Column:
        """Expected stats share as one expression. Where the feature is missing: mix both children's (mix), follow the
        heavier child (larger), the left one (left), take the node's own (node), or mix the children's labels (vote).
        """
        n = self.nodes[k]
        if self.leaf(k):
            return F.lit(float(n.values()[which]))
        left, right = self.value(which, 2 * k, missing), self.value(which, 2 * k + 1, missing)
        known = F.when(goes_left(n), 1.0).otherwise(0.0)
        lost = {"larger": 1.0 if n.p_left >= 0.5 else 0.0, "left": 1.0}.get(missing, n.p_left)
        share = F.when(F.col(n.feature).isNull(), lost).otherwise(known)
        mixed = share * left + (1 - share) * right  # each child once, so a tree's expression grows with its nodes
        if missing in ("node", "vote"):
            p = self.nodes[2 * k].label() == which, self.nodes[2 * k + 1].label() == which
            instead = float(n.values()[which]) if missing == "node" else n.p_left * p[0] + (1 - n.p_left) * p[1]
            return F.when(F.col(n.feature).isNull(), instead).otherwise(mixed)
        return mixed

    def shape(self) -> dict[str, int]:
        """nodes, leaves and depth (0 for a lone root) of what can be reached."""
        level, depth, nodes, leaves = [1], 0, 0, 0
        while level:
            nodes, leaves = nodes + len(level), leaves + sum(map(self.leaf, level))
            level = [c for k in level if not self.leaf(k) for c in (2 * k, 2 * k + 1)]
            depth += bool(level)
        return {"nodes": nodes, "leaves": leaves, "depth": depth}

    def prune(self, k: int) -> None:
        """Node k becomes a leaf."""
        for child in (2 * k, 2 * k + 1):
            if child in self.nodes:
                self.prune(child)
                del self.nodes[child]
        self.nodes[k].feature = None

    def importance(self) -> dict[str, float]:
        """Share of the total gain by feature."""
        out: dict[str, float] = {}
        for n in self.nodes.values():
            if n.feature is not None:
                out[n.feature] = out.get(n.feature, 0.0) + n.gain
        whole = sum(out.values()) or 1.0
        return {f: g / whole for f, g in sorted(out.items())}

    def render(self, k: int = 1, depth: int = 0) -> str:
        n, pad = self.nodes[k], "  " * depth
        if self.leaf(k):
            return f"{pad}{[round(v, 4) for v in n.values()]} ({n.weight:g})"
        test = f"{n.feature} <= {n.threshold:g}" if n.category is None else f"{n.feature} = {n.category}"
        return "\n".join([pad + test, self.render(2 * k, depth + 1), self.render(2 * k + 1, depth + 1)])


def goes_left(n: Node) -> Column:
    return F.col(n.feature) <= n.threshold if n.category is None else F.col(n.feature) == n.category


def _impurity(stats: list[Column], weight: Column, criterion: str) -> Column:
    """Weight times impurity, but for what is the same before and after a split. Smaller is purer."""
    if criterion == "entropy":
        return sum((F.when(s > 0, -s * F.log2(s / weight)).otherwise(0.0) for s in stats), F.lit(0.0))
    if criterion == "misclassification":
        return weight - (F.greatest(*stats) if len(stats) > 1 else stats[0])
    if criterion == "quarter":  # 4 p (1 - p), of two classes
        return 4 * stats[-1] * (weight - stats[-1]) / weight
    return -sum((s * s for s in stats), F.lit(0.0)) / weight


def best_splits(rows: DataFrame, numeric: list[str], categorical: list[str], n_stats: int, criterion: str = "gini", least: float = 1.0, per_node: int | None = None, seed: int = 0, drawn: list[list[int]] | None = None) -> DataFrame:
    """node, feature, threshold or category, gain, stats and weights of the best split of each node.

    rows: node, w, c0 to c{n_stats-1} (stats times w) and the features. The gain counts the share of rows whose value
    is known. Thresholds are midpoints of neighbouring values; equal gains: first feature by place, then lowest value.
    per_node draws that many features for each node by hash; drawn names the nodes that may take each feature instead.
    """
    stats = [f"c{k}" for k in range(n_stats)]
    sums = [F.sum(c).alias(c) for c in ("w", *stats)]
    whole = rows.groupBy("node").agg(*[F.sum(c).alias(f"all_{c}") for c in ("w", *stats)])
    parts = []
    for kind, features in (("double", numeric), ("string", categorical)):
        if not features:
            continue
        place = {f: k for k, f in enumerate([*numeric, *categorical])}
        pairs = F.explode(F.array(*[F.struct(F.lit(place[f]).alias("f"), F.col(f).cast(kind).alias("v")) for f in features]))
        long = rows.select("node", "w", *stats, pairs.alias("p")).select("node", "w", *stats, "p.*").where("v is not null")
        if per_node is not None:
            # a node's features by hash order; chosen before counting, so that only they are shuffled
            order = F.array_sort(F.array(*[F.struct(hash_bucket(F.concat_ws(":", F.col("node"), F.lit(k)), seed, 1 << 30).alias("h"), F.lit(k).alias("k")) for k in range(len(place))]))
            long = long.where(F.array_contains(F.transform(F.slice(order, 1, per_node), lambda s: s.k), F.col("f")))
        if drawn is not None:
            long = long.where(functools.reduce(operator.or_, ((F.col("f") == k) & F.col("node").isin(nodes) for k, nodes in enumerate(drawn))))
        cells = long.groupBy("node", "f", "v").agg(*sums)
        names = ["w", *stats]
        if kind == "double":
            up = running_sums_within(cells, ["node", "f"], "v", names, "_following")
            cells = up.select("node", "f", ((F.col("v") + F.col("_following")) / 2).alias("threshold"), F.lit(None).cast("string").alias("category"), *[F.col(f"up_{c}").alias(f"l_{c}") for c in names], *[F.col(f"all_{c}").alias(f"k_{c}") for c in names])
            cells = cells.where("threshold is not null")
        else:
            known = cells.groupBy("node", "f").agg(*[F.sum(c).alias(f"k_{c}") for c in names])
            cells = cells.join(known, ["node", "f"]).select("node", "f", F.lit(None).cast("double").alias("threshold"), F.col("v").alias("category"), *[F.col(c).alias(f"l_{c}") for c in names], *[f"k_{c}" for c in names])
        parts.append(cells)
    cells = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    cells = cells.join(whole, "node").where((F.col("l_w") >= least) & (F.col("k_w") - F.col("l_w") >= least))
    known, left, right = ([F.col(f"k_{c}") for c in stats], [F.col(f"l_{c}") for c in stats], [F.col(f"k_{c}") - F.col(f"l_{c}") for c in stats])
    gain = _impurity(known, F.col("k_w"), criterion) - _impurity(left, F.col("l_w"), criterion) - _impurity(right, F.col("k_w") - F.col("l_w"), criterion)
    # the largest gain, then the first feature, the lowest value: a minimum, so a task sends one row a node
    first = F.min(F.struct((-F.round(gain / F.col("all_w"), 10)).alias("loss"), "f", "threshold", "category", (F.col("l_w") / F.col("k_w")).alias("p_left")))
    best = cells.groupBy("node").agg(first.alias("b"))
    names = F.array(*[F.lit(f) for f in [*numeric, *categorical]])
    return best.select("node", F.get(names, F.col("b.f")).alias("feature"), "b.threshold", "b.category", (-F.col("b.loss")).alias("gain"), "b.p_left")


def _expand(rows: DataFrame, tree: Tree, level: list[int]) -> DataFrame:
    """Rows at the split nodes of this level go to children; a row whose value is missing goes to both, in shares."""
    to = F.lit(None).cast("array<struct<node:int,share:double>>")
    for k in level:
        n = tree.nodes[k]
        if n.feature is None:
            continue
        one = lambda child, share=1.0: F.struct(F.lit(child).alias("node"), F.lit(float(share)).alias("share"))
        both = F.array(one(2 * k, n.p_left), one(2 * k + 1, 1 - n.p_left))
        target = F.when(F.col(n.feature).isNull(), both).when(goes_left(n), F.array(one(2 * k))).otherwise(F.array(one(2 * k + 1)))
        to = F.when(F.col("node") == k, target).otherwise(to)
    stats = [c for c in rows.columns if c == "w" or c[0] == "c" and c[1:].isdigit()]
    moved = rows.withColumn("_to", F.explode(to)).where("_to.share > 0")
    return moved.withColumns({c: F.col(c) * F.col("_to.share") for c in stats} | {"node": F.col("_to.node")}).drop("_to")


def grow(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), classes: list | None = None, depth: int = 4, criterion: str = "gini", least: float = 1.0, min_gain: float = 1e-9, weight: str | None = None, per_node: int | None = None, seed: int = 0) -> Tree:
    """A tree: of a classification for given classes, else of a regression. Null labels and weights of 0 are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = [(F.col(label) == c).cast("double") for c in classes] if classes else [F.col(label).cast("double")]
    rows = df.where(F.col(label).isNotNull()).select(*numeric, *categorical, F.lit(1).alias("node"), w.alias("w"), *[(w * v).alias(f"c{k}") for k, v in enumerate(y)]).where("w > 0")
    tree, level = Tree(), [1]
    rows = written(rows)
    for d in range(depth + 1):
        sums = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("w", *[f"c{k}" for k in range(len(y))])]).collect()
        for r in sums:
            tree.nodes[r["node"]] = Node([r[f"c{k}"] for k in range(len(y))], r["w"])
        if not sums or d == depth:
            break
        for r in best_splits(rows, list(numeric), list(categorical), len(y), criterion, least, per_node, seed).collect():
            if r["gain"] > min_gain:
                n = tree.nodes[r["node"]]
                n.feature, n.threshold, n.category, n.gain, n.p_left = r["feature"], r["threshold"], r["category"], r["gain"] * n.weight, r["p_left"]
        level = [r["node"] for r in sums if not tree.leaf(r["node"])]
        if not level:
            break
        rows = written(_expand(rows, tree, level))
    tree.nodes = tree.nodes or {1: Node([0.0] * len(y), 0.0)}
    for k in [k for k in tree.nodes if not tree.leaf(k) and (2 * k not in tree.nodes or 2 * k + 1 not in tree.nodes)]:
        tree.prune(k)
    return tree


def predict_class(tree: Tree, classes: list) -> Column:
    """The class with the largest share, the first of equal ones."""
    shares = F.array(*[F.round(tree.value(k), 12) for k in range(len(classes))])
    return F.get(F.array(*map(F.lit, classes)), F.array_position(shares, F.array_max(shares)).cast("int") - 1)


def reduced_error_prune(tree: Tree, df: DataFrame, label: str, classes: list) -> Tree:
    """Leaves instead of subtrees, bottom up, wherever that does not cost accuracy on df.

    One aggregation finds each node's class counts; the choice is then made on the driver's node table.
    """
    rows = df.select("*", F.lit(1).alias("node"), F.lit(1.0).alias("w"), *[(F.col(label) == c).cast("double").alias(f"c{k}") for k, c in enumerate(classes)])
    counts: dict[int, list[float]] = {}
    level = [1]
    while level:
        for r in rows.groupBy("node").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(classes))]).collect():
            counts[r["node"]] = [r[f"c{k}"] for k in range(len(classes))]
        split = [k for k in level if not tree.leaf(k)]
        if not split:
            break
        rows, level = _expand(rows, tree, split), [c for k in split for c in (2 * k, 2 * k + 1)]

    def right(k: int) -> float:
        own = counts.get(k, [0.0] * len(classes))[max(range(len(classes)), key=tree.nodes[k].stats.__getitem__)]
        if tree.leaf(k):
            return own
        below = right(2 * k) + right(2 * k + 1)
        if own >= below:
            tree.prune(k)
            return own
        return below

    right(1)
    return tree


def cost_complexity_path(tree: Tree) -> list[tuple[float, int]]:
    """(alpha, leaves) as the weakest link is cut, again and again; the tree ends as its root. Cost: 1 - largest share."""
    out = []
    total = tree.nodes[1].weight or 1.0

    def below(k: int) -> tuple[float, int]:
        n = tree.nodes[k]
        if tree.leaf(k):
            return (n.weight - max(n.stats)) / total, 1
        a, b = below(2 * k), below(2 * k + 1)
        return a[0] + b[0], a[1] + b[1]

    while not tree.leaf(1):
        links = []
        for k, n in tree.nodes.items():
            if not tree.leaf(k):
                cost, leaves = below(k)
                links.append((((n.weight - max(n.stats)) / total - cost) / (leaves - 1), k))
        alpha, k = min(links)
        tree.prune(k)
        out.append((round(alpha, 10), below(1)[1]))
    return out


@dataclass
class Forest:
    trees: list[Tree]
    classes: list
    seed: int

    def shares(self) -> Column:
        return F.array(*[sum((t.value(k) for t in self.trees), F.lit(0.0)) / len(self.trees) for k in range(len(self.classes))])

    def predict(self) -> Column:
        s = self.shares()
        return F.get(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int") - 1)

    def oob_hit(self, key: str, label: str) -> Column:
        """1.0 where the trees that did not draw the row judge it right, 0.0 where wrong, null where each drew it."""
        drew = [F.coalesce(F.col(key).isNotNull() & (poisson_times(F.lit(t), F.col(key), self.seed) > 0), F.lit(False)) for t in range(len(self.trees))]
        votes = [sum((F.when(d, 0.0).otherwise(tree.value(k)) for d, tree in zip(drew, self.trees, strict=True)), F.lit(0.0)) for k in range(len(self.classes))]
        s = F.array(*votes)
        said = F.get(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int") - 1)
        return F.when(~functools.reduce(operator.and_, drew), (said == F.col(label)).cast("double"))

    def oob(self, df: DataFrame, key: str, label: str, shuffled: str | None = None) -> float:
        """Accuracy where each row is judged by the trees that did not draw it. shuffled: a feature dealt anew first."""
        if shuffled:
            df = permuted(df, key, shuffled, self.seed)
        return df.agg(F.avg(self.oob_hit(key, label))).head()[0]

    def oob_importance(self, df: DataFrame, key: str, label: str, features: list[str]) -> dict[str, float]:
        """Loss of out-of-bag accuracy when a feature is dealt anew."""
        base = self.oob(df, key, label)
        return {f: base - self.oob(df, key, label, f) for f in features}


def permuted(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """df with the column's values dealt anew within hash blocks of the keys, which bounds each task."""
    block = hash_bucket(F.col(key), seed + 1, 64)
    spread = df.withColumn("_b", block)
    a = spread.withColumn("_p", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    b = spread.select("_b", F.col(column).alias("_v"), F.row_number().over(Window.partitionBy("_b").orderBy(hash_bucket(F.col(key), seed + 2, 1 << 30), key)).alias("_p"))
    return a.join(b, ["_b", "_p"]).withColumn(column, F.col("_v")).drop("_b", "_p", "_v")


def _grow_bags(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], classes: list, bags: list[tuple[int, int]], depth: int, seed: int) -> list[Tree]:
    """The tree of each (bag, features a node): all grow together, a pass a level.

    The trees are subtrees of one: tree t begins at node R + t, so that nodes keep their numbering by halves.
    """
    first, features = 1 << (len(bags) - 1).bit_length(), [*numeric, *categorical]
    w = F.col("_times").cast("double")
    times = [F.struct(F.lit(first + j).alias("node"), F.col(f"_times{t}").alias("_times")) for j, (t, _) in enumerate(bags)]
    rows = df.where(F.col(label).isNotNull() & F.col(key).isNotNull()).withColumns({f"_times{t}": poisson_times(F.lit(t), F.col(key), seed) for t in {t for t, _ in bags}})
    rows = rows.select(*features, F.col(label).alias("_y"), F.explode(F.array(*times)).alias("_bag")).where("_bag._times > 0").select(*features, "_y", "_bag.*")
    rows = written(rows.select(*features, "node", w.alias("w"), *[(w * (F.col("_y") == c).cast("double")).alias(f"c{k}") for k, c in enumerate(classes)]))
    whole = Tree()
    for d in range(depth + 1):
        sums = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("w", *[f"c{k}" for k in range(len(classes))])]).collect()
        for r in sums:
            whole.nodes[r["node"]] = Node([r[f"c{k}"] for k in range(len(classes))], r["w"])
        if not sums or d == depth:
            break
        drawn: list[list[int]] = [[] for _ in features]
        for r in sums:
            j, k = (r["node"] >> d) - first, (r["node"] & ((1 << d) - 1)) + (1 << d)
            t, per_node = bags[j]
            order = sorted(range(len(features)), key=lambda f, t=t, k=k: (int(hashlib.md5(f"{seed + t}:{k}:{f}".encode()).hexdigest()[:8], 16) % (1 << 30), f))
            for f in order[:per_node]:
                drawn[f].append(r["node"])
        for r in best_splits(rows, list(numeric), list(categorical), len(classes), drawn=drawn).collect():
            if r["gain"] > 1e-9:
                n = whole.nodes[r["node"]]
                n.feature, n.threshold, n.category, n.gain, n.p_left = r["feature"], r["threshold"], r["category"], r["gain"] * n.weight, r["p_left"]
        level = [r["node"] for r in sums if not whole.leaf(r["node"])]
        if not level:
            break
        rows = written(_expand(rows, whole, level))
    out = []
    for j in range(len(bags)):
        root, tree = first + j, Tree()
        for d in range(depth + 1):
            tree.nodes |= {k + (1 << d): whole.nodes[(root << d) + k] for k in range(1 << d) if (root << d) + k in whole.nodes}
        tree.nodes = tree.nodes or {1: Node([0.0] * len(classes), 0.0)}
        for k in [k for k in tree.nodes if not tree.leaf(k) and (2 * k not in tree.nodes or 2 * k + 1 not in tree.nodes)]:
            if k in tree.nodes:
                tree.prune(k)
        out.append(tree)
    return out


def _cut(tree: Tree, depth: int) -> Tree:
    """The tree's first levels."""
    last = 1 << depth
    return Tree({k: n if k < last else Node(n.stats, n.weight) for k, n in tree.nodes.items() if k < 2 * last})


def grow_forest(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], classes: list, trees: int = 10, depth: int = 4, per_node: int | None = None, seed: int = 0) -> Forest:
    """Trees on Poisson bootstraps of the rows, drawn by hash, with features drawn for each node. Keys are unique; rows without one are in no bag."""
    per_node = per_node or max(1, round(math.sqrt(len(numeric) + len(categorical))))
    return Forest(_grow_bags(df, key, label, numeric, categorical, classes, [(t, per_node) for t in range(trees)], depth, seed), classes, seed)


def search_forest(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], classes: list, grid: list[dict], seed: int = 0) -> tuple[dict, list[tuple[dict, float]]]:
    """The grid's entry (trees, depth, per_node of grow_forest) of the best out-of-bag accuracy, the first of equal ones, and all scores.

    Entries of one per_node share their trees: fewer trees are the first of them, a smaller depth their first levels. The
    trees of the whole grid grow in the same passes and are judged in one.
    """
    usual = max(1, round(math.sqrt(len(numeric) + len(categorical))))
    full = [{"trees": 10, "depth": 4} | o | {"per_node": o.get("per_node") or usual} for o in grid]
    bags = sorted({(t, o["per_node"]) for o in full for t in range(o["trees"])})
    grown = dict(zip(bags, _grow_bags(df, key, label, numeric, categorical, classes, bags, max(o["depth"] for o in full), seed), strict=True))
    forests = [Forest([_cut(grown[t, o["per_node"]], o["depth"]) for t in range(o["trees"])], classes, seed) for o in full]
    found = df.agg(*[F.avg(f.oob_hit(key, label)) for f in forests]).head()
    scores = [(options, s or 0.0) for options, s in zip(grid, found, strict=True)]
    return max(scores, key=lambda s: s[1])[0], scores
