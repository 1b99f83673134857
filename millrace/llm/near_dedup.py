"""MinHash near-duplicates by a chosen-path set similarity join.

Every tree starts with all documents in one node. A node branches by MinHash tokens: its members go to the children of
the tokens that the node selects. Small nodes are compared exhaustively on full shingle sets, larger ones branch again,
LEVELS times at most; what branching can't thin is compared with some pivots first, and only members that are not linked
with the largest component of the pivots go on to a comparison with all, in blocks. Independent trees repeat the walk; what
one of them has put in a group is not compared again for another. A pair at the threshold shares a child with probability
0.75, one of two children with 0.94: so after two levels 16 trees miss it with 4e-9, and with 2e-10 where the first nodes
are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, maybe_broadcast, row_key, written

#: Trees; the tokens of a signature (the first TREES of them for the roots); levels of branching; children below the first level.
TREES, COORDS, WIDTH, LEVELS, BRANCHES = 16, 48, 5, 2, 2
#: A node of more members or more shingles branches.
LEAF, LEAF_SHINGLES = 512, 500_000
#: What one task compares with each other; larger groups are dealt to tasks of about that much.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Nodes that branch of which each task gets the numbers at a time; there is one for every 512 rows of classes and trees at most, or 500,000 shingles.
LARGE_NODES = 1_000_000
#: Pivots of a dealt group, about; fewer if they have more than BLOCK_SHINGLES.
PIVOTS = 128
#: Rows of one class from which its label is broadcast, so that no task gets all of them.
HOT = 10_000

_MULTIPLIERS = np.random.default_rng(20_240_607).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of five words; of the whole sequence if it has fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    run = _mixed(h[:n] + np.uint64(width))
    for j in range(1, width):
        run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(run)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS MinHash values of a set."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _MULTIPLIERS).min(axis=0), out=low)
    return _mixed(low)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            sizes, classes, keys = [], [], []
            for text in batch.column(2).slice(at, 1024):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 1024), batch.column(1).slice(at, 1024), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.binary())],
                names=["doc_id", "_key", "n_shingles", "class", "sig"],
            )
    give_back()


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, COORDS)


def _chosen(sig: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The BRANCHES children of each (signature, node), by tokens that the node selects; one after the other."""
    keys = []
    for b in range(BRANCHES):
        chosen = _mixed(node + np.uint64(b + 1))
        token = sig[np.arange(len(node)), (chosen % np.uint64(COORDS)).astype(np.int64)]
        keys.append(_mixed(chosen * np.uint64(0x9E3779B97F4A7C15) + token))
    return np.concatenate(keys)


def _nodes(larges: list):
    """Of each class (rep, size, sig) its nodes below those that are in larges, a sorted array a level.

    Without larges these are its children of every tree's root. A class's nodes follow from its signature alone, so
    that no row of a class and a node is joined with the class.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(2))
            node = _mixed(sig[:, :TREES] + np.arange(TREES, dtype=np.uint64)).reshape(-1)
            of = np.repeat(np.arange(batch.num_rows), TREES)
            for large in larges:
                at = np.searchsorted(large.value, node).clip(max=len(large.value) - 1)
                inside = np.flatnonzero(large.value[at] == node)
                node, of = _chosen(sig[of[inside]], node[inside]), np.tile(of[inside], BRANCHES)
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["node", "rep", "size"])

    return placed


def _broadcast_nodes(large: DataFrame) -> list:
    """Shared sorted arrays of the nodes, of LARGE_NODES at most each; a large node has more than LEAF rows or LEAF_SHINGLES."""
    spark, parts = large.sparkSession, max(1, -(-large.count() // LARGE_NODES))
    own = F.pmod(F.xxhash64("node"), F.lit(parts))
    columns = (large.where(own == k).toArrow().column("node").to_numpy() for k in range(parts))
    return [spark.sparkContext.broadcast(np.sort(np.ascontiguousarray(c).view(np.uint64))) for c in columns if len(c)]


def _common(sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """Intersection sizes of all pairs of sets, or of the first sets with all."""
    _, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1  # a shingle of one member adds to no intersection
    column = np.cumsum(shared) - 1
    keep = shared[where]
    owner, where = owner[keep], column[where[keep]]
    by_column = np.argsort(where, kind="stable")
    owner, where = owner[by_column], where[by_column]
    common = np.zeros((len(sets) if first is None else first, len(sets)), np.float64)
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(where, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], where[a:b] - low] = 1
        common += part[:first] @ part.T
    return common.astype(np.int64)


def _linked(sets: list[np.ndarray], percent: int, first: int | None = None) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, of the pairs of _common."""
    sizes, inter = np.array([len(s) for s in sets], np.int64), _common(sets, first)
    return 100 * inter >= percent * (sizes[:first, None] + sizes[None, :] - inter)


def _roots_of(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """The first member of the component of each of n members."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def _frame(rows: list[tuple], *names: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(names), dtype="Int64")


def _members(pdf: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
    pdf = pdf.drop_duplicates("rep").sort_values("rep")
    return pdf["rep"].tolist(), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]


def _compare(percent: int):
    """A group's share: the whole of a small group is compared with each other, of a dealt one each member with the pivots.

    Links are (a, b). All that the largest component of the pivots links is one component, so its members need no more
    comparisons; each other member of a dealt group gives (center, null, member, its shingles).
    """

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, center = ("a", "b", "other", "size"), int(key[0])
        ids, sets = _members(pdf)
        if len(ids) < 2:
            return _frame([], *names)
        at = {x: k for k, x in enumerate(ids)}
        whole = pdf["tasks"].iloc[0] == 1
        first = ids if whole else sorted(pdf.loc[pdf["pivot"], "rep"].unique().tolist())
        others = sorted(set(ids) - set(first))
        ids = [*first, *others]
        linked = _linked([sets[at[x]] for x in ids], percent, len(first))
        root = np.array(_roots_of(len(first), *np.nonzero(np.triu(linked[:, : len(first)], 1))))
        joined = [(first[r], x, None, None) for r, x in zip(root.tolist(), first, strict=True) if first[r] != x]
        if whole:
            return _frame(joined, *names)
        main = root == np.bincount(root).argmax()
        rest = [(center, None, x, len(sets[at[x]])) for x, inside in zip(first, main, strict=True) if not inside]
        rows = joined + rest if key[1] == 0 else []  # every share has all pivots
        to_main = linked[main][:, len(first) :]
        link = np.array(first)[main][to_main.argmax(axis=0)].tolist()
        rows += [(p, x, None, None) if yes else (center, None, x, len(sets[at[x]])) for p, x, yes in zip(link, others, to_main.any(axis=0), strict=True)]
        return _frame(rows, *names)

    return compared


def _compare_rest(percent: int):
    """Links that connect what is linked of members outside the pivots' component (side 0) and a share of all (side 1)."""

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (ids, sets), (others, theirs) = _members(pdf[pdf["side"] == 0]), _members(pdf[pdf["side"] == 1])
        if not ids or not others:
            return _frame([], "a", "b")
        x, y = np.nonzero(_linked(sets + theirs, percent, len(ids))[:, len(ids) :])
        both = ids + others
        return _frame([(both[r], both[k]) for k, r in enumerate(_roots_of(len(both), x, y + len(ids))) if both[r] != both[k]], "a", "b")

    return compared


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["class", "shingles"])
    give_back()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the graph of links (a, b), component the smallest node reachable.

    Rounds of large-star and small-star, each an aggregation and a join; the edges are written each round.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        star = both.join(maybe_broadcast(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = written(star)
        low = written(star.groupBy("u").agg(F.min("v").alias("m")))
        small = star.join(maybe_broadcast(low), "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(after.where("u <> v").distinct())
        # done when each node has one edge and no node that is pointed at points on
        heads = after.groupBy("u").count().where("count > 1").limit(1).count()
        if not heads and not after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def _groups(reps: DataFrame) -> DataFrame:
    """(center, rep, size): classes that share a small or last node with center, its smallest member; center included.

    reps has rep (a class), size (its shingles) and sig.
    """
    of_reps, ways = reps.select("rep", "size", "sig"), [[]]
    stars, members = [], written(of_reps.mapInArrow(_nodes([]), "node long, rep long, size long"))
    for level in range(1, LEVELS + 1):
        nodes = members.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("rep").alias("center"), F.max("rep").alias("last"))
        nodes = written(nodes.where("n > 1"))
        # nodes of two are pairs already; only larger ones need their members
        stars.append(nodes.where("n = 2").select("center", F.explode(F.array("center", "last")).alias("rep"), F.ceil(F.col("total") / 2).alias("size")))
        larger = nodes.where("n > 2").select("node", "n", "total", "center")
        small = F.lit(True) if level == LEVELS else (F.col("n") <= LEAF) & (F.col("total") <= LEAF_SHINGLES)
        # a size is what a member adds to its group, for the dealing only
        stars.append(members.join(maybe_broadcast(larger.where(small).select("node", "center")), "node").select("center", "rep", "size"))
        large = larger.where(~small).select("node")
        if level == LEVELS or not large.limit(1).count():
            break
        ways = [[*way, part] for part in _broadcast_nodes(large) for way in ways]
        below = [of_reps.mapInArrow(_nodes(way), "node long, rep long, size long") for way in ways]
        members = below[0]
        for more in below[1:]:
            members = members.unionByName(more)
        members = written(members)
    star = stars[0]
    for more in stars[1:]:
        star = star.unionByName(more)
    return written(star.groupBy("center", "rep").agg(F.max("size").alias("size")))


def _homes(star: DataFrame) -> DataFrame:
    """star with home: the largest group of each class, of equal ones the smallest center; without groups that are redundant.

    Two classes of one home are compared there, so no other group that both are in has to compare them again: trees
    find the same groups over and over. A group all of whose members have one home elsewhere goes.
    """
    sizes = maybe_broadcast(written(star.groupBy("center").agg(F.count("*").alias("n"))))
    own = F.max(F.struct("n", (-F.col("center")).alias("c"))).over(Window.partitionBy("rep"))  # a class is in a few groups a tree
    star = written(star.join(sizes, "center").select("center", "rep", "size", (-own["c"]).alias("home")))
    kept = star.groupBy("center").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high or low = center").select("center")
    return star.join(maybe_broadcast(written(kept)), "center", "left_semi")


def _found_links(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within the groups."""
    star = written(_homes(star))
    classes = star.groupBy("center", "home").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    groups = classes.groupBy("center").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(F.struct("n", "home")).alias("most"))
    tasks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    pivots = F.least(F.lit(PIVOTS), F.floor(BLOCK_SHINGLES * F.col("n") / F.col("total")))
    # of a dealt group, what has been compared elsewhere: half of it or more that has one home there
    done = F.when((tasks > 1) & (F.col("most.home") != F.col("center")) & (2 * F.col("most.n") >= F.col("n")), F.col("most.home"))
    groups = written(groups.select("center", "n", tasks.alias("tasks"), pivots.alias("pivots"), done.alias("done")))
    known = groups.where("done is not null")
    fresh = star.join(maybe_broadcast(groups.where("done is null").select("center", "n", "tasks", "pivots")), "center")
    # pivots are chosen by hash, in every share; the center is always one
    pivot = (F.col("rep") == F.col("center")) | (F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n")) < F.col("pivots"))
    shares = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int")))
    dealt = fresh.withColumn("pivot", pivot).select("center", "rep", "tasks", "pivot", F.explode(shares).alias("share"))
    dealt = maybe_broadcast(written(dealt))
    compared = written(dealt.join(sets, "rep").groupBy("center", "share").applyInPandas(_compare(percent), "a long, b long, other long, size long"))
    links = compared.where("b is not null").select("a", "b").distinct()
    rest = compared.where("other is not null").select(F.col("a").alias("center"), F.col("other").alias("rep"), "size").distinct()
    rest = written(rest.unionByName(star.join(maybe_broadcast(known.select("center", "done")), "center").where("home <> done").select("center", "rep", "size")))
    if not rest.limit(1).count():
        return written(links)
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    counted = written(rest.groupBy("center").agg(parts.alias("parts")).join(maybe_broadcast(groups), "center"))
    counted = maybe_broadcast(counted)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    mine = rest.join(counted, "center").select("center", "rep", part.alias("i"), every(F.col("tasks")).alias("j"), F.lit(0).alias("side"))
    share = F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int")
    all_of = star.join(counted, "center").select("center", "rep", share.alias("j"), every(F.col("parts")).alias("i"), F.lit(1).alias("side"))
    pairs = written(mine.select("center", "i", "j", "rep", "side").unionByName(all_of.select("center", "i", "j", "rep", "side")))
    more = pairs.join(sets, "rep").groupBy("center", "i", "j").applyInPandas(_compare_rest(percent), "a long, b long")
    return written(links.unionByName(more.distinct()))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, _key and _group of every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct 5-word shingles.
    Null, empty and blank texts have an empty set and are linked with nothing: component_id is doc_id, _group null.
    Equal sets (128-bit hashes) are one class before any comparison, so copies cost no pairs; classes, not ids, are
    compared, so rows of one doc_id with different texts are documents of their own and may be in different groups.
    A null doc_id stays null and is never kept apart: its component_id is null and kept is true. _group names the
    component also where ids repeat; _key is row_key(doc_id, text).
    """
    signed = docs.select("doc_id", row_key("doc_id", "text").alias("_key"), "text").mapInArrow(_signed, "doc_id long, _key string, n_shingles long, class binary, sig binary")
    signed = written(signed)
    some = signed.where("class is not null and doc_id is not null")
    reps = some.groupBy("class").agg(F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()))  # written once, so a class keeps its number
    slim, star = reps.select("class", "rep", "low", "rows"), _groups(reps)
    wanted = written(slim.join(maybe_broadcast(written(star.select("rep").distinct())), "rep", "left_semi"))
    texts = docs.join(maybe_broadcast(wanted.select(F.col("low").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "class binary, shingles binary").join(maybe_broadcast(wanted.select("class", "rep")), "class").select("rep", "shingles")
    if signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.groupBy("rep").agg(F.first("shingles").alias("shingles"))  # ids repeat, so a class may come more than once
    sets = written(sets)
    found = components(_found_links(star, sets, percent))
    # the smallest doc_id of each component of several classes
    several = found.select(F.col("node").alias("rep"), "component").unionByName(found.select(F.col("component").alias("rep"), "component").distinct())
    several = written(slim.select("rep", "low").join(maybe_broadcast(written(several)), "rep"))
    lowest = maybe_broadcast(written(several.groupBy("component").agg(F.min("low").alias("component_id"))))
    named = written(several.drop("low").join(lowest, "component"))
    label = slim.join(maybe_broadcast(named), "rep", "left")
    label = written(label.select("class", "rows", F.coalesce("component", "rep").alias("_group"), F.coalesce("component_id", "low").alias("component_id")))
    rows = signed.select("doc_id", "_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    # classes of many rows are few and broadcast, the others shuffled
    hot = label.where(F.col("rows") > HOT).select("class", F.col("_group").alias("_g"), F.col("component_id").alias("_c"))
    marked = rows.join(maybe_broadcast(hot), "class", "left")
    done = marked.where("_g is not null").select("doc_id", "_key", "n_shingles", F.col("_c").alias("component_id"), F.col("_g").alias("_group"))
    other = marked.where("_g is null and class is not null").select("doc_id", "_key", "n_shingles", "class").join(label.where(F.col("rows") <= HOT).select("class", "component_id", "_group"), "class")
    alone = rows.where("class is null").withColumns({"component_id": F.col("doc_id"), "_group": F.lit(None).cast("long")})
    out = done.unionByName(other.drop("class")).unionByName(alone.drop("class"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "_key", "_group")
