"""Boosting and forests on histogram trees: a level of all trees is one pass over the binned rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_bucket, sigmoid, softmax
from millrace.sources.storage import written

from .histogram import BINS, Bins, Grower, _matrix, binned, finished, fit_bins, grow_all, indicators, label_codes, predictions, target
from .prepare import bootstrap, drawn_with_replacement, drawn_without_replacement
from .trees import Tree


@dataclass
class Boosted:
    """start plus rate times steps[k] times each tree. history, held: the mean loss after each round, and of held-out rows."""

    start: float
    rate: float
    trees: list[Tree]
    loss: str
    history: list[float]
    steps: list[float] = field(default_factory=list)
    held: list[float] = field(default_factory=list)

    def score(self) -> Column:
        return sum((self.rate * a * t.value() for t, a in zip(self.trees, self.steps, strict=True)), F.lit(self.start))

    def predict(self) -> Column:
        return sigmoid(self.score()) if self.loss == "logistic" else self.score()


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def _loss(y: np.ndarray, score: np.ndarray, loss: str) -> np.ndarray:
    if loss == "squared":
        return (y - score) ** 2
    p = _sigmoid(score)
    return -(y * np.log(p + 1e-15) + (1 - y) * np.log(1 - p + 1e-15))


def _added(rows: DataFrame, n: int, numbers: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sums over all rows of the n numbers that each batch gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += numbers(batch)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], [f"s{k}" for k in range(n)])

    row = rows.mapInArrow(run, ", ".join(f"s{k} double" for k in range(n))).agg(*[F.sum(f"s{k}") for k in range(n)]).head()
    return np.array([v or 0.0 for v in row])


def boost(
    df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), loss: str = "squared", rounds: int = 10, rate: float = 0.1, depth: int = 2,
    key: str | None = None, subsample: float = 1.0, newton: bool = False, cut_every: int = 10, stop_after: int | None = None, seed: int = 0,
    bins: int = BINS, held_out: Column | None = None, steps: list[float] | str | None = None,
) -> Boosted:
    """Gradient boosting: each round grows a regression tree on the residuals y - F (squared) or y - p (logistic, y 0/1).

    newton divides each leaf's mean residual by its mean p * (1 - p). subsample draws rows by the hash of key.
    steps: None takes whole trees; "exact" the least squares step along each tree; a list the step of the smallest
    training loss, of equal ones the first: the losses of all of them, over training and held-out rows, are one pass.
    held_out rows are not fitted. stop_after ends when the loss of the held-out rows, or without them of the training
    rows, has not fallen for so many rounds; the trees after the best round are then dropped if rows are held out.
    Rows without a label are left out. Scores are written every cut_every rounds.
    """
    df = df.where(F.col(label).isNotNull())
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    mean = df.where(~held).agg(F.avg(F.col(label).cast("double"))).head()[0] or 0.0
    start = mean if loss == "squared" else math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
    model = Boosted(start, rate, [], loss, [])
    cut = fit_bins(df, list(numeric), list(categorical), bins)
    draw = F.col(key) if subsample < 1 and key else F.lit(0)
    rows = binned(df, cut, y=F.col(label).cast("double"), held=held, key=draw, s=F.lit(start))
    done = 0  # trees that are in the written scores

    def scored(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        base = batch.column("s").to_numpy(zero_copy_only=False)
        return base + sum((rate * a * v[:, 0] for a, v in zip(tail[1], tail[0](x), strict=True)), np.zeros(len(x)))

    def stats(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        y, s = batch.column("y").to_numpy(zero_copy_only=False), scored(batch, x)
        p = s if loss == "squared" else _sigmoid(s)
        return np.stack([y - p, np.ones(len(y)) if loss == "squared" else p * (1 - p), _loss(y, s, loss)], axis=1)

    for k in range(rounds + 1):
        tail = predictions(model.trees[done:], cut, 1), model.steps[done:]
        drawn = F.lit(1.0) if subsample == 1 or not key else (hash_bucket(F.col("key"), seed + k, 10_000) < int(10_000 * subsample)).cast("double")
        own, out = (~F.col("held")).cast("double"), F.col("held").cast("double")
        growers = [Grower(1, depth if k < rounds else 0, "sse", weight=0), Grower(1, 0, weight=1), Grower(1, 0, weight=2)]
        grow_all(rows.withColumn("w", F.array(own * drawn, own, out)), cut, growers, stats, extra=2)
        if k:
            for g, losses in ((growers[1], model.history), (growers[2], model.held)):
                if g.sums[1][0]:
                    losses.append(float(g.sums[1][3] / g.sums[1][0]))
            watched = model.held or model.history
            if stop_after and len(watched) > stop_after and min(watched[-stop_after:]) >= min(watched[:-stop_after]):
                break
        if k == rounds:
            break
        tree = finished(growers[0].tree, 1)
        if newton and loss == "logistic":
            for node, n in tree.nodes.items():
                total = growers[0].sums[node]
                n.stats = [n.stats[0] / max(total[2] / max(total[0], 1e-300), 1e-9)]
        model.trees.append(tree)
        model.steps.append(_step(rows, cut, tree, scored, steps, loss, rate) if steps else 1.0)
        if (k + 1) % cut_every == 0 and k + 1 < rounds:
            tail = predictions(model.trees[done:], cut, 1), model.steps[done:]
            rows, done = _rescored(rows, scored), len(model.trees)
    if model.held and stop_after:
        best = int(np.argmin(model.held)) + 1
        model.trees, model.steps = model.trees[:best], model.steps[:best]
    return model


def _rescored(rows: DataFrame, scored) -> DataFrame:
    """rows, written with new scores s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scored(batch, _matrix(batch.column("x"), batch.num_rows, np.int16)) if batch.num_rows else np.zeros(0)
            yield batch.set_column(batch.schema.get_field_index("s"), "s", pa.array(s))

    return written(rows.mapInArrow(run, rows.schema))


def _step(rows: DataFrame, cut: Bins, tree: Tree, scored, steps: list[float] | str, loss: str, rate: float) -> float:
    """The step along a tree: the exact one of squares, or that of a list with the smallest training loss."""
    value, tries = predictions([tree], cut, 1), [] if steps == "exact" else list(steps)

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("x"), batch.num_rows, np.int16)
        own = ~batch.column("held").to_numpy(zero_copy_only=False)
        y, s, t = batch.column("y").to_numpy(zero_copy_only=False)[own], scored(batch, x)[own], value(x)[0][own, 0]
        p = s if loss == "squared" else _sigmoid(s)
        return np.array([((y - p) * t).sum(), (t * t).sum(), *[_loss(y, s + rate * a * t, loss).sum() for a in tries]])

    found = _added(rows, 2 + len(tries), numbers)
    if steps == "exact":
        return float(found[0] / found[1]) if found[1] else 1.0
    return float(tries[int(np.argmin(np.round(found[2:], 9)))])


@dataclass
class BoostedClasses:
    classes: list
    start: list[float]
    rate: float
    rounds: list[list[Tree]]
    history: list[float]

    def shares(self) -> Column:
        """Each class's probability, in the order of classes."""
        return softmax(F.array(*[sum((self.rate * r[k].value() for r in self.rounds), F.lit(x)) for k, x in enumerate(self.start)]))

    def predict(self) -> Column:
        s = self.shares()
        return F.get(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int") - 1)


def boost_classes(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), rounds: int = 5, rate: float = 0.3, depth: int = 2, newton: bool = False, bins: int = BINS) -> BoostedClasses:
    """Softmax boosting: each round grows one regression tree a class on its indicator less its probability, all together.

    Scores start at the logarithms of the classes' shares. newton divides a leaf's mean residual by its mean p * (1 - p),
    times (classes - 1) / classes. history holds the mean log-loss. Rows without a label are left out; an empty table
    has no classes and is an error.
    """
    df = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not counts:
        raise ValueError("no labelled rows")
    classes, total = sorted(counts), sum(counts.values())
    n = len(classes)
    model = BoostedClasses(classes, [math.log(counts[c] / total) for c in classes], rate, [], [])
    cut = fit_bins(df, list(numeric), list(categorical), bins)
    rows = binned(df, cut, y=label_codes(label, classes))

    def stats(batch: pa.RecordBatch, x: np.ndarray) -> list[np.ndarray]:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        s = np.array(model.start)[None, :] + rate * np.stack([sum((v[:, 0] for v in said(x)[k::n]), np.zeros(len(x))) for k in range(n)], axis=1)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        lost = -np.log(p[np.arange(len(y)), y] + 1e-15)
        return [np.stack([(y == k) - p[:, k], p[:, k] * (1 - p[:, k]), lost], axis=1) for k in range(n)]

    for k in range(rounds + 1):
        said = predictions([t for r in model.rounds for t in r], cut, 1)
        growers = [Grower(1, depth if k < rounds else 0, "sse") for _ in classes]
        grow_all(rows, cut, growers, stats, extra=2)
        if k:
            model.history.append(float(growers[0].sums[1][3] / growers[0].sums[1][0]))
        if k < rounds:
            for g in growers if newton else []:
                for node, t in g.tree.nodes.items():
                    t.stats = [t.stats[0] * (n - 1) / n / max(g.sums[node][2] / max(g.sums[node][0], 1e-300), 1e-9)]
            model.rounds.append([finished(g.tree, 1) for g in growers])
    return model


@dataclass
class BinnedForest:
    """rows: the binned table with key, y (the class's place, or the number) and w (how often each tree drew the row).

    classes is empty for a regression, whose prediction is value().
    """

    trees: list[Tree]
    classes: list
    bins: Bins
    rows: DataFrame
    seed: int

    def shares(self) -> Column:
        return F.array(*[sum((t.value(k) for t in self.trees), F.lit(0.0)) / len(self.trees) for k in range(len(self.classes))])

    def predict(self) -> Column:
        s = self.shares()
        return F.get(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int") - 1)

    def value(self) -> Column:
        return sum((t.value() for t in self.trees), F.lit(0.0)) / len(self.trees)

    def _votes(self):
        said = predictions(self.trees, self.bins, len(self.classes))

        def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Shares by tree, row and class; whether a tree left the row out; the label."""
            x, w = _matrix(batch.column("x"), batch.num_rows, np.int16), _matrix(batch.column("w"), batch.num_rows, np.float64)
            return np.stack(said(x)), (w == 0).T, batch.column("y").to_numpy(zero_copy_only=False)

        return run

    def oob(self, upto: list[int] | None = None) -> list[float]:
        """Accuracy by the mean share of the trees that left a row out, over rows that any tree did; for each number of first trees."""
        upto, votes = upto or [len(self.trees)], self._votes()

        def numbers(batch: pa.RecordBatch) -> np.ndarray:
            shares, left, y = votes(batch)
            out = []
            for n in upto:
                sums = (shares[:n] * left[:n, :, None]).sum(axis=0)
                seen = left[:n].any(axis=0)
                out += [(np.round(sums, 12).argmax(axis=1) == y)[seen].sum(), seen.sum()]
            return np.array(out, float)

        found = _added(self.rows, 2 * len(upto), numbers)
        return [float(found[2 * k] / found[2 * k + 1]) if found[2 * k + 1] else 0.0 for k in range(len(upto))]

    def oob_r2(self) -> float:
        """Of a regression forest: 1 less the squared error by that of the mean, over rows that any tree left out; 0 if they don't vary."""
        said = predictions(self.trees, self.bins, 1)

        def numbers(batch: pa.RecordBatch) -> np.ndarray:
            x, left = _matrix(batch.column("x"), batch.num_rows, np.int16), (_matrix(batch.column("w"), batch.num_rows, np.float64) == 0).T
            y, n = batch.column("y").to_numpy(zero_copy_only=False), left.sum(axis=0)
            p = (np.stack(said(x))[:, :, 0] * left).sum(axis=0)[n > 0] / n[n > 0]
            y = y[n > 0]
            return np.array([len(y), ((y - p) ** 2).sum(), y.sum(), (y * y).sum()], float)

        n, error, total, squares = _added(self.rows, 4, numbers)
        spread = squares - total * total / n if n else 0.0
        return float(1 - error / spread) if spread > 0 else 0.0

    def tree_oob(self) -> list[float]:
        """Each tree's own accuracy over the rows that it left out; 0 where it left out none."""
        votes = self._votes()

        def numbers(batch: pa.RecordBatch) -> np.ndarray:
            shares, left, y = votes(batch)
            hit = (np.round(shares, 12).argmax(axis=2) == y[None]) & left
            return np.concatenate([hit.sum(axis=1), left.sum(axis=1)]).astype(float)

        found = _added(self.rows, 2 * len(self.trees), numbers)
        return [float(a / b) if b else 0.0 for a, b in zip(found[: len(self.trees)], found[len(self.trees) :], strict=True)]

    def kept(self, good: list[bool]) -> BinnedForest:
        """The forest of some of its trees: weak ones can be dropped by their tree_oob()."""
        at = [k for k, g in enumerate(good) if g]
        rows = self.rows.withColumn("w", F.array(*[F.col("w")[k] for k in at]) if at else F.array().cast("array<double>"))
        return BinnedForest([self.trees[k] for k in at], self.classes, self.bins, rows, self.seed)

    def weighted_shares(self) -> Column:
        """Shares by the trees' votes, weighted by their out-of-bag accuracy."""
        w = self.tree_oob()
        whole = sum(w) or 1.0
        return F.array(*[sum((t.value(k) * (a / whole) for t, a in zip(self.trees, w, strict=True)), F.lit(0.0)) for k in range(len(self.classes))])

    def importance(self) -> dict[str, float]:
        """Mean of the trees' shares of gain."""
        each = [t.importance() for t in self.trees]
        return {f: sum(e.get(f, 0.0) for e in each) / len(each) for f in self.bins.features}

    def permuted_drops(self, repeats: int = 1) -> DataFrame:
        """(tree, feature, repeat, n, kept, dropped): hits of each tree over the n rows that it left out, as they are and with a feature dealt anew.

        Values are dealt within a tree's own left-out rows. One join deals for all trees, features and repeats at once:
        rows are numbered twice by hashes within ranges, and the row at a place takes the bin of the row at that place
        of the other order.
        """
        trees, features, seed = len(self.trees), len(self.bins.features), self.seed
        left = self.rows.select("key", "y", "x", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.get(F.col("w"), t) == 0)).alias("tree"))
        left = left.withColumn("part", hash_bucket(F.concat_ws(":", "tree", "key"), seed + 7, PARTS))
        left = written(left.withColumn("place", F.row_number().over(_within("tree", "part").orderBy("key"))))
        dealt = left.select("tree", "part", "key", "x", F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
        order = hash_bucket(F.concat_ws(":", "tree", "j", "repeat", "key"), seed + 8, 1 << 30)
        donors = dealt.withColumn("place", F.row_number().over(_within("tree", "part", "j", "repeat").orderBy(order, "key"))).select("tree", "part", "place", "j", "repeat", F.get(F.col("x"), F.col("j")).alias("bin"))
        pairs = left.join(donors, ["tree", "part", "place"]).select("tree", "j", "repeat", "y", "x", "bin")
        said = [predictions([t], self.bins, len(self.classes)) for t in self.trees]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                x = _matrix(batch.column("x"), batch.num_rows, np.int16)
                tree, j, r, y, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "j", "repeat", "y", "bin"))
                other = x.copy()
                other[np.arange(len(x)), j] = b
                for t in np.unique(tree):
                    at = tree == t
                    hits = [np.round(said[t](v[at])[0], 12).argmax(axis=1) == y[at] for v in (x, other)]
                    for f, k in {*zip(j[at].tolist(), r[at].tolist(), strict=True)}:
                        mine = (j[at] == f) & (r[at] == k)
                        found[int(t), f, k] = found.get((int(t), f, k), np.zeros(3, np.int64)) + [mine.sum(), hits[0][mine].sum(), hits[1][mine].sum()]
            if found:
                rows = [(*key, *map(int, v)) for key, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["tree", "j", "repeat", "n", "kept", "dropped"])

        counted = pairs.mapInArrow(run, "tree long, j long, repeat long, n long, kept long, dropped long")
        name = F.get(F.array(*map(F.lit, self.bins.features)), F.col("j").cast("int"))
        return counted.groupBy("tree", name.alias("feature"), "repeat").agg(*[F.sum(c).alias(c) for c in ("n", "kept", "dropped")])

    def permutation_importance(self, repeats: int = 1) -> DataFrame:
        """(feature, importance, deviation, relative): mean over trees and repeats of the loss of out-of-bag accuracy.

        relative divides by the trees' mean accuracy. Trees that left out no row have no part in it.
        """
        each = self.permuted_drops(repeats).withColumn("drop", (F.col("kept") - F.col("dropped")) / F.col("n"))
        own = F.avg(F.col("kept") / F.col("n"))
        return each.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation"), (F.avg("drop") / F.nullif(own, F.lit(0.0))).alias("relative"))


#: Hash parts of a tree's left-out rows; values are dealt within them, so no task holds all of them.
PARTS = 16


def _within(*columns: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*columns)


def grow_binned_forest(
    df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], classes: list | None, trees: int = 10, depth: int = 4,
    per_node: int | None = None, per_tree: int | None = None, seed: int = 0, bag: str = "exact", size: int | float | None = None, bins: int = BINS,
) -> BinnedForest:
    """A forest whose trees grow together, a pass a level.

    bag: "exact" draws as many rows as there are, or size of them, with replacement; "share" draws size (a number, or a
    share below 1; 0.632 by default) without; "poisson" draws each row Poisson(1) times. Features are drawn for each node
    (per_node; the root of their number by default) and, as random subspaces, for each tree (per_tree). Without classes
    it is a forest of regressions. Keys are unique; rows without a label are left out.
    """
    df = df.where(F.col(label).isNotNull())
    if bag == "poisson":
        drawn = bootstrap(df, key, trees, seed)
    elif bag == "exact":
        drawn = drawn_with_replacement(df, key, trees, None if size is None else int(size), seed)
    else:
        drawn = drawn_without_replacement(df, key, trees, 0.632 if size is None else size, seed)
    drawn = drawn.where("times > 0").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tree", "times"))).alias("_times"))  # trees of a row
    times = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("_times", t), F.lit(0)).cast("double"))
    cut = fit_bins(df, list(numeric), list(categorical), bins)
    y = label_codes(label, classes) if classes else F.col(label).cast("double")
    rows = binned(df.join(drawn, key, "left"), cut, key=F.col(key), y=y, w=times)
    n, size = len(cut.features), len(classes or [0])
    per_node = per_node or max(1, round(math.sqrt(per_tree or n)))
    own = [tuple(sorted(sorted(range(n), key=lambda k, t=t: _draw(f"{seed}:{t}:{k}"))[:per_tree])) if per_tree else None for t in range(trees)]
    growers = [Grower(size, depth, "gini" if classes else "sse", per_node=per_node, seed=seed + t, weight=t, allowed=own[t]) for t in range(trees)]
    grow_all(rows, cut, growers, indicators(size) if classes else target)
    return BinnedForest([finished(g.tree, size) for g in growers], classes or [], cut, rows, seed)


def _draw(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def search_binned_forest(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], classes: list, grid: list[dict], trees: int = 10, seed: int = 0, bins: int = BINS) -> tuple[dict, list[tuple[dict, float]]]:
    """The entry of the grid (depth, per_node, criterion, least) with the best out-of-bag accuracy, the first of equal ones, and all scores.

    The trees of all entries share their bags and grow in the same passes, so the jobs do not depend on the grid's size.
    """
    df = df.where(F.col(label).isNotNull())
    drawn = drawn_with_replacement(df, key, trees, None, seed).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tree", "times"))).alias("_times"))
    times = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("_times", t), F.lit(0)).cast("double"))
    cut = fit_bins(df, list(numeric), list(categorical), bins)
    rows = binned(df.join(drawn, key, "left"), cut, key=F.col(key), y=label_codes(label, classes), w=times)
    growers = [[Grower(len(classes), seed=seed + t, weight=t, **options) for t in range(trees)] for options in grid]
    grow_all(rows, cut, [g for one in growers for g in one], indicators(len(classes)))
    said = predictions([finished(g.tree, len(classes)) for one in growers for g in one], cut, len(classes))

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        x, left = _matrix(batch.column("x"), batch.num_rows, np.int16), (_matrix(batch.column("w"), batch.num_rows, np.float64) == 0).T
        y, shares, seen = batch.column("y").to_numpy(zero_copy_only=False), np.stack(said(x)), left.any(axis=0)
        hits = [(np.round((shares[trees * k : trees * (k + 1)] * left[:, :, None]).sum(axis=0), 12).argmax(axis=1) == y)[seen].sum() for k in range(len(grid))]
        return np.array([seen.sum(), *hits], float)

    found = _added(rows, 1 + len(grid), numbers)
    scores = [(options, float(h / found[0]) if found[0] else 0.0) for options, h in zip(grid, found[1:], strict=True)]
    return max(scores, key=lambda s: s[1])[0], scores
