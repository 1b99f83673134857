"""Trees whose nodes have any number of children: a table of nodes and one of children, rows routed by joins.

A categorical split has a child for each value, a numeric one two. Both tables are DataFrames, as wide categories make
many nodes; they are broadcast only while they are counted to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ranks import running_sums_within
from millrace.sources.storage import written

from .trees import _impurity

#: Rows of a node table that are broadcast at most; a row has a few numbers and a category.
BROADCAST_ROWS = 1_000_000
ROOT = 1
#: Hits in shares.
_HITS = "decimal(38,18)"


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


@dataclass
class NaryTree:
    """nodes: node, depth, w, stats, feature (place; null at leaves), threshold. children: node, key, child, share."""

    numeric: list[str]
    categorical: list[str]
    classes: list
    nodes: DataFrame
    children: DataFrame
    depth: int

    def _key(self) -> Column:
        return _branch(self.numeric, self.categorical)

    def ends(self, df: DataFrame, key: str) -> DataFrame:
        """(key, node, share): where each row ends. A missing value goes to all children in shares, an unseen one ends at its node."""
        return self._walk(df, key, every=False)

    def _walk(self, df: DataFrame, key: str, every: bool) -> DataFrame:
        """As ends(), or with every node on the way."""
        splits = self.nodes.where("feature is not null").select("node", F.col("feature").alias("_f"), F.col("threshold").alias("_t"))
        splits, children = _small(splits), _small(self.children.select("node", F.col("key").alias("_key"), "child", F.col("share").alias("_share")))
        each = _small(self.children.groupBy("node").agg(F.collect_list(F.struct("child", "share")).alias("_all")))
        rows = df.select(F.col(key), *self.numeric, *self.categorical, F.lit(ROOT).cast("long").alias("node"), F.lit(1.0).alias("share"))
        done = []
        for _ in range(self.depth):
            if every:
                done.append(rows.select(key, "node", "share"))
            at = rows.join(splits, "node", "left").withColumn("_key", F.when(F.col("_f").isNotNull(), self._key()))
            to = at.join(children, ["node", "_key"], "left").join(each, "node", "left")
            lost = F.col("_f").isNotNull() & F.col("_key").isNull()
            moves = F.when(lost, F.col("_all")).when(F.col("child").isNotNull(), F.array(F.struct("child", F.lit(1.0).alias("share"))))
            if not every:
                done.append(to.where(~lost & F.col("child").isNull()).select(key, "node", "share"))
            moved = to.withColumn("_m", F.explode(moves)).select(key, *self.numeric, *self.categorical, F.col("_m.child").alias("node"), (F.col("share") * F.col("_m.share")).alias("share"))
            rows = written(moved)
        done.append(rows.select(key, "node", "share"))
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out

    def shares(self, df: DataFrame, key: str) -> DataFrame:
        """(key, shares): each row's probability of the classes, in their order. Keys are unique."""
        stats = self.nodes.select("node", F.transform("stats", lambda s: s / F.col("w")).alias("_p"))
        ended = self.ends(df, key).join(_small(stats), "node")
        return ended.groupBy(key).agg(F.array(*[F.sum(F.col("share") * F.col("_p")[k]) for k in range(len(self.classes))]).alias("shares"))

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, predicted): the likeliest class, the first of equal ones."""
        best = F.transform("shares", lambda s: F.round(s, 12))
        place = F.array_position(best, F.array_max(best)).cast("int") - 1
        return self.shares(df, key).select(key, F.get(F.array(*map(F.lit, self.classes)), place).alias("predicted"))

    def shape(self) -> DataFrame:
        """One row: nodes, leaves, depth and the most children of a node."""
        widest = self.children.groupBy("node").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("widest"))
        return self.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("feature").isNull()).alias("leaves"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).crossJoin(widest)  # one row each

    def importance(self) -> DataFrame:
        """(feature, importance): shares of the total gain."""
        names = F.array(*map(F.lit, [*self.numeric, *self.categorical]))
        each = self.nodes.where("feature is not null").groupBy(F.get(names, F.col("feature")).alias("feature")).agg(F.sum(F.col("gain") * F.col("w")).alias("g"))
        total = each.agg(F.sum("g")).head()[0] or 1.0
        return each.select("feature", (F.col("g") / total).alias("importance"))

    def pruned(self, df: DataFrame, key: str, label: str) -> NaryTree:
        """Leaves instead of subtrees, bottom up, wherever that does not cost hits on df; a missing value counts in shares."""
        way = self._walk(df.where(F.col(label).isNotNull()), key, every=True).join(df.select(key, F.col(label).alias("_y")), key)
        seen = F.array_position(F.array(*map(F.lit, self.classes)), F.col("_y")).cast("int")
        share = F.col("share").cast("decimal(20,18)")  # sums of these are exact, so that equal numbers of hits stay equal in any order
        counts = way.groupBy("node").agg(*[F.sum(F.when(seen == k + 1, share)).cast(_HITS).alias(f"h{k}") for k in range(len(self.classes))])
        said = F.array_position("stats", F.array_max("stats")).cast("int") - 1
        own = self.nodes.join(counts, "node", "left").select("node", "depth", F.col("feature").isNotNull().alias("split"), F.coalesce(F.get(F.array(*[F.col(f"h{k}") for k in range(len(self.classes))]), said), F.lit(0).cast(_HITS)).alias("own"))
        own, edges = written(own), self.children.select(F.col("node").alias("parent"), F.col("child").alias("node"))
        best, cut = None, None
        for d in range(self.depth, -1, -1):
            here = own.where(F.col("depth") == d)
            if best is not None:
                below = best.join(edges, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("right").cast(_HITS).alias("below"))
                here = here.join(below, "node", "left")
            else:
                here = here.withColumn("below", F.lit(None).cast(_HITS))
            # the shares of a row add up to 1 but for their last digits
            more = F.coalesce("below", F.lit(0).cast(_HITS)) - F.col("own")
            stop = F.col("split") & (more.cast("double") <= F.greatest(F.lit(5e-10), F.col("own").cast("double") * 1e-14))
            here = written(here.select("node", stop.alias("stop"), F.when(F.col("split") & ~stop, F.col("below")).otherwise(F.col("own")).alias("right")))
            gone = here.where("stop").select("node")
            cut = gone if cut is None else cut.unionByName(gone)
            best = here.select("node", "right")
        return self._without(written(cut))

    def _without(self, cut: DataFrame) -> NaryTree:
        """The tree with these nodes as leaves; what lies below them goes."""
        children, gone = self.children, cut
        for _ in range(self.depth):
            lower = written(children.join(_small(gone), "node", "left_semi").select(F.col("child").alias("node")))
            children = written(children.join(_small(gone), "node", "left_anti"))
            cut, gone = cut.unionByName(lower.select("node")), lower
        reached = children.select(F.col("child").alias("node")).unionByName(self.nodes.where(F.col("depth") == 0).select("node"))
        nodes = self.nodes.join(_small(written(reached)), "node", "left_semi").join(_small(written(children.select("node").distinct().withColumn("_s", F.lit(True)))), "node", "left")
        keep = F.col("_s").isNotNull()
        nodes = nodes.withColumns({c: F.when(keep, F.col(c)) for c in ("feature", "threshold", "gain")}).drop("_s")
        return NaryTree(self.numeric, self.categorical, self.classes, written(nodes), children, self.depth)


def _branch(numeric: list[str], categorical: list[str]) -> Column:
    """The branch of a row at a node that splits by feature _f (place) at _t; null if its value is missing."""
    key: Column = F.lit(None).cast("string")
    for k, c in enumerate(numeric):
        key = F.when(F.col("_f") == k, F.when(F.col(c).cast("double") <= F.col("_t"), "<=").when(F.col(c).isNotNull(), ">")).otherwise(key)
    for k, c in enumerate(categorical, len(numeric)):
        key = F.when(F.col("_f") == k, F.concat(F.lit("="), F.col(c).cast("string"))).otherwise(key)
    return key


def _candidates(rows: DataFrame, whole: DataFrame, numeric: list[str], categorical: list[str], n: int, criterion: str) -> DataFrame:
    """(node, f, threshold, gain) of every split; rows with a missing value count in all branches, in their shares."""
    names = ["w", *[f"c{k}" for k in range(n)]]
    sums = [F.sum(c).alias(c) for c in names]
    both = None

    def filled(part: str, known: str) -> list[Column]:
        """A branch's weight and stats with its share of what is missing."""
        share = F.col(f"{part}_w") / F.col(f"{known}_w")
        return [F.col(f"{part}_{c}") + share * (F.col(f"whole_{c}") - F.col(f"{known}_{c}")) for c in names]

    def impure(values: list[Column]) -> Column:
        return _impurity(values[1:], values[0], criterion)

    before = impure([F.col(f"whole_{c}") for c in names])
    for kind, features, start in (("double", numeric, 0), ("string", categorical, len(numeric))):
        if not features:
            continue
        pairs = F.explode(F.array(*[F.struct(F.lit(start + k).alias("f"), F.col(c).cast(kind).alias("v")) for k, c in enumerate(features)]))
        cells = rows.select("node", *names, pairs.alias("p")).select("node", *names, "p.*").where("v is not null").groupBy("node", "f", "v").agg(*sums)
        if kind == "double":
            up = running_sums_within(cells, ["node", "f"], "v", names, "_following").where("_following is not null").join(whole, "node")
            for c in names:
                up = up.withColumn(f"rest_{c}", F.col(f"all_{c}") - F.col(f"up_{c}"))
            gain = before - impure(filled("up", "all")) - impure(filled("rest", "all"))
            found = up.select("node", "f", ((F.col("v") + F.col("_following")) / 2).alias("threshold"), (gain / F.col("whole_w")).alias("gain"))
        else:
            known = cells.groupBy("node", "f").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
            up = cells.join(known, ["node", "f"]).join(whole, "node").withColumnsRenamed({c: f"up_{c}" for c in names})
            after = up.groupBy("node", "f").agg(F.sum(impure(filled("up", "all"))).alias("after"), F.count("*").alias("n"), F.first(before).alias("before"), F.first("whole_w").alias("whole_w"))
            found = after.where("n > 1").select("node", "f", F.lit(None).cast("double").alias("threshold"), ((F.col("before") - F.col("after")) / F.col("whole_w")).alias("gain"))
        both = found if both is None else both.unionByName(found)
    return both


def grow_nary(df: DataFrame, label: str, numeric: list[str], categorical: list[str], classes: list, depth: int = 4, criterion: str = "gini", least: float = 2.0, min_gain: float | None = None) -> NaryTree:
    """A tree with a child for each category. Rows whose label is not one of the classes are left out.

    A node is split while it is not pure and has weight least; by the largest gain (rounded to ten digits), the first
    feature, the lowest threshold, even if nothing is gained unless min_gain says how much more than it must be. A missing
    value counts in every branch with the branch's share of the known weight.
    """
    n = len(classes)
    names = ["w", *[f"c{k}" for k in range(n)]]
    stats = [(F.col(label) == c).cast("double").alias(f"c{k}") for k, c in enumerate(classes)]
    rows = written(df.where(F.col(label).isin(classes)).select(*numeric, *categorical, F.lit(ROOT).cast("long").alias("node"), F.lit(1.0).alias("w"), *stats))
    nodes, children = [], []
    for d in range(depth + 1):
        whole = written(rows.groupBy("node").agg(*[F.sum(c).alias(f"whole_{c}") for c in names]))
        level = whole.select("node", F.lit(d).alias("depth"), F.col("whole_w").alias("w"), F.array(*[f"whole_c{k}" for k in range(n)]).alias("stats"))
        closed = level.withColumns({"feature": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double"), "gain": F.lit(None).cast("double")})
        if d == depth:
            nodes.append(closed)
            break
        open_ = whole.where((F.col("whole_w") >= least) & (F.greatest(*[F.col(f"whole_c{k}") for k in range(n)], F.lit(0.0)) < F.col("whole_w")))
        found = _candidates(rows, _small(open_), numeric, categorical, n, criterion)
        if min_gain is not None:
            found = found.where(F.col("gain") > min_gain)
        first = F.min(F.struct((-F.round("gain", 10)).alias("loss"), "f", "threshold"))
        best = written(found.groupBy("node").agg(first.alias("b")).select("node", F.col("b.f").alias("_f"), F.col("b.threshold").alias("_t"), (-F.col("b.loss")).alias("gain")))
        nodes.append(level.join(_small(best), "node", "left").withColumnsRenamed({"_f": "feature", "_t": "threshold"}))
        if not best.limit(1).count():
            break
        at = rows.join(_small(best.drop("gain")), "node").withColumn("_key", _branch(numeric, categorical))
        known = at.where("_key is not null").groupBy("node", F.col("_key").alias("key")).agg(F.sum("w").alias("_w"))
        total = known.groupBy("node").agg(F.sum("_w").alias("_k"))
        made = written(known.join(total, "node").select("node", "key", F.xxhash64("node", "key").alias("child"), (F.col("_w") / F.col("_k")).alias("share")))
        children.append(made)
        own = at.where("_key is not null").join(_small(made.withColumnRenamed("key", "_key")), ["node", "_key"]).withColumn("share", F.lit(1.0))
        each = _small(made.groupBy("node").agg(F.collect_list(F.struct("child", "share")).alias("_all")))
        lost = at.where("_key is null").join(each, "node").withColumn("_m", F.explode("_all")).withColumns({"child": F.col("_m.child"), "share": F.col("_m.share")}).drop("_all", "_m")
        moved = own.unionByName(lost)
        rows = written(moved.select(*numeric, *categorical, F.col("child").alias("node"), *[(F.col(c) * F.col("share")).alias(c) for c in names]))
    spark = df.sparkSession
    all_nodes = nodes[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)
    edges = spark.createDataFrame([], "node long, key string, child long, share double")
    for x in children:
        edges = edges.unionByName(x)
    return NaryTree(list(numeric), list(categorical), classes, written(all_nodes), written(edges), len(children))
