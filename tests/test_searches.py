"""Searches, item models, bags, histogram trees and wide trees against plain versions on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_bucket
from millrace.operators import ensembles, histogram, mixture_search, nary, prepare, slim, trees


@pytest.fixture(scope="module")
def ratings(spark):
    draw = random.Random(3)
    rows = [(u, i, float(draw.randint(1, 5))) for u in range(30) for i in range(12) if draw.random() < 0.6]
    return rows, spark.createDataFrame(rows, "user long, item long, rating double").repartition(3).cache()


def near_all(spark, items):
    return spark.createDataFrame([(a, b) for a in items for b in items if a != b], "item long, other long")


def test_slim_meets_its_optimality_conditions(spark, ratings, monkeypatch):
    """For each weight: zero gradient where it is positive, none that pulls up where it is zero; by folds, and in pieces by user."""
    rows, df = ratings
    monkeypatch.setattr(slim, "PIECE", 5)
    dealt = slim.with_folds(df, 3)
    fold = {(r.user, r.item): r.fold for r in dealt.collect()}
    grid = [(0.5, 1.0), (5.0, 20.0)]
    found = {(r.config, r.fold, r.src, r.dst): r.weight for r in slim.slim_near(dealt, near_all(spark, range(12)), grid, 3).collect()}
    x = np.zeros((30, 12))
    for u, i, r in rows:
        x[u, i] = r
    for f in (-1, 0, 1, 2):
        y = x * np.array([[fold.get((u, i)) != f for i in range(12)] for u in range(30)])
        g = y.T @ y
        for k, (l1, l2) in enumerate(grid):
            for dst in range(12):
                w = np.array([found.get((k, f, s, dst), 0.0) for s in range(12)])
                assert w[dst] == 0 and (w >= 0).all()
                slope = g @ w - g[:, dst] + l1 + l2 * w
                for s in range(12):
                    if s != dst:
                        assert abs(slope[s]) < 1e-5 if w[s] > 0 else slope[s] > -1e-5


def test_slim_search_errors_by_hand(spark, ratings):
    rows, df = ratings
    grid = [(0.5, 1.0), (5.0, 20.0)]
    scores, best = slim.search_slim(df, near_all(spark, range(12)), grid, 3, 1.0, 5.0)
    dealt = slim.with_folds(df, 3)
    fold = {(r.user, r.item): r.fold for r in dealt.collect()}
    w = {(r.config, r.fold, r.src, r.dst): r.weight for r in slim.slim_near(dealt, near_all(spark, range(12)), grid, 3).collect()}
    want = {}
    for k in range(2):
        each = []
        for f in range(3):
            off = []
            for u, i, r in rows:
                if fold[u, i] == f:
                    s = sum(q * w.get((k, f, j, i), 0.0) for v, j, q in rows if v == u and fold[v, j] != f)
                    off.append((min(5.0, max(1.0, s)) - r) ** 2)
            each.append(math.sqrt(sum(off) / len(off)))
        want[k] = sum(each) / 3
    got = {r.config: r for r in scores.collect()}
    assert {k: r.rmse for k, r in got.items()} == pytest.approx(want)
    assert [k for k, r in got.items() if r.best] == [min(want, key=want.get)] and best.count() > 0


def test_mixture_search_is_that_of_single_fits(spark):
    """Each model's EM in plain numpy from the same starts."""
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(m, 0.5, (40, 2)) for m in ((0, 0), (4, 1), (0, 5))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(4)
    hashed = df.select("id", hash_bucket(F.col("id"), 0, 3).alias("f"), hash_bucket(F.col("id"), 1, 1 << 31).alias("h")).collect()
    fold, order = {r.id: r.f for r in hashed}, [r.id for r in sorted(hashed, key=lambda r: (r.h, r.id))]
    grid = [{"k": 1, "kind": "diag"}, {"k": 3, "kind": "full"}, {"k": 2, "kind": "diag"}]
    found = mixture_search.search_mixtures(df, ["a", "b"], "id", grid, folds=3, rounds=6, tolerance=0.0)

    def logs(p, weights, means, covs):
        out = np.empty((len(p), len(weights)))
        for j in range(len(weights)):
            d = p - means[j]
            out[:, j] = math.log(weights[j]) - 0.5 * ((d @ np.linalg.inv(covs[j])) * d).sum(axis=1) - 0.5 * math.log(np.linalg.det(covs[j])) - math.log(2 * math.pi)
        return out

    for (g, mean, each), want in zip(found.scores, grid, strict=True):
        assert g == want and mean == pytest.approx(sum(each) / 3)
        for f in range(3):
            own = x[[i for i in range(len(x)) if fold[i] != f]]
            start = [x[i] for i in order if fold[i] != f][: g["k"]]
            weights, means, covs = np.full(g["k"], 1 / g["k"]), np.array(start), np.array([np.diag(own.var(axis=0)) + 1e-6 * np.eye(2)] * g["k"])
            for _ in range(6):
                r = np.exp(logs(own, weights, means, covs))
                r /= r.sum(axis=1, keepdims=True)
                n = r.sum(axis=0)
                weights, means = n / n.sum(), r.T @ own / n[:, None]
                covs = np.array([(own - m).T @ ((own - m) * r[:, [j]]) / n[j] for j, m in enumerate(means)])
                covs = (covs if g["kind"] == "full" else np.array([np.diag(np.diag(c)) for c in covs])) + 1e-6 * np.eye(2)
            held = x[[i for i in range(len(x)) if fold[i] == f]]
            assert each[f] == pytest.approx(np.log(np.exp(logs(held, weights, means, covs)).sum(axis=1)).mean(), abs=1e-6)
    assert found.best == grid[1] and len(found.model.history) == 6


def test_bags_have_exact_sizes(spark):
    df = spark.createDataFrame([(k * 7,) for k in range(101)], "k long").repartition(5)
    for size, want in ((None, 101), (40, 40), (500, 500)):
        drawn = prepare.drawn_with_replacement(df, "k", 4, size, seed=5).collect()
        assert {t: sum(r.times for r in drawn if r.tree == t) for t in range(4)} == dict.fromkeys(range(4), want)
        assert len({(r.tree, r.k) for r in drawn}) == len(drawn) and {r.k for r in drawn} <= {k * 7 for k in range(101)}
    part = prepare.drawn_without_replacement(df, "k", 3, 0.632).collect()
    assert Counter(r.tree for r in part) == dict.fromkeys(range(3), 64) and len({(r.tree, r.k) for r in part}) == len(part)
    assert prepare.drawn_with_replacement(df.limit(0), "k", 2).collect() == []


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(9)
    rows = [(k, draw.choice([None, *range(40)]), draw.choice([None, "a", "b", "c", "d"]), float(draw.randrange(12)), draw.choice("xyz")) for k in range(600)]
    return spark.createDataFrame(rows, "k long, v int, c string, u double, y string").repartition(4).cache()


@pytest.mark.parametrize("criterion", ["gini", "entropy", "misclassification"])
def test_histogram_trees_are_the_exact_ones(mixed, criterion):
    """With a bin for each value, and siblings by subtraction or, with little room, counted in many passes."""
    exact = trees.grow(mixed, "y", ["v", "u"], ["c"], list("xyz"), depth=4, criterion=criterion)
    bounded = histogram.grow_binned(mixed, "y", ["v", "u"], ["c"], list("xyz"), depth=4, criterion=criterion)
    cut = histogram.fit_bins(mixed, ["v", "u"], ["c"])
    rows = histogram.binned(mixed, cut, y=histogram.label_codes("y", list("xyz")))
    narrow = histogram.Grower(3, 4, criterion)
    histogram.grow_all(rows, cut, [narrow], histogram.indicators(3), cells=400)
    for tree in (bounded, narrow.tree):
        assert set(tree.nodes) == set(exact.nodes)
        for k, n in exact.nodes.items():
            m = tree.nodes[k]
            assert (m.feature, m.threshold, m.category) == (n.feature, n.threshold, n.category)
            assert [m.weight, m.p_left, *m.stats] == pytest.approx([n.weight, n.p_left, *n.stats])


def test_bounded_bins_are_quantiles(spark):
    values = [float(k * k % 97) for k in range(97)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    exact, sketch = histogram.fit_bins(df, ["v"], bins=10), histogram.fit_bins(df, ["v"], bins=10, exact=False)
    known = [v for v in values if v is not None]
    assert np.allclose(exact.edges[0], np.unique(np.quantile(known, [k / 10 for k in range(1, 10)])))
    assert exact.points == (None,) and len(sketch.edges[0]) <= 9 and np.abs(sketch.edges[0] - exact.edges[0][: len(sketch.edges[0])]).max() <= 3
    assert histogram.fit_bins(df.limit(0), ["v"]).sizes == [2]


def test_a_forest_is_its_trees_grown_alone(mixed):
    forest = ensembles.grow_binned_forest(mixed, "k", "y", ["v", "u"], ["c"], list("xyz"), trees=3, depth=3, per_tree=2, per_node=2, seed=4)
    for t, tree in enumerate(forest.trees):
        bag = prepare.drawn_with_replacement(mixed, "k", 3, None, 4).where(F.col("tree") == t).select("k", "times")
        own = [f for f in forest.bins.features if f in {n.feature for n in tree.nodes.values()}]
        assert len(own) <= 2 and tree.nodes[1].weight == 600
        if own:
            alone = trees.grow(mixed.join(bag, "k"), "y", [f for f in own if f != "c"], [f for f in own if f == "c"], list("xyz"), depth=1, weight="times")
            assert alone.nodes[1].stats == tree.nodes[1].stats
    assert sum(forest.importance().values()) == pytest.approx(1)
    curve = forest.oob([1, 2, 3])
    assert len(curve) == 3 and curve[2] == forest.oob()[0]
    weak = forest.tree_oob()
    strong = forest.kept([w >= np.mean(weak) for w in weak])
    assert 1 <= len(strong.trees) < 3 and strong.tree_oob() == [w for w in weak if w >= np.mean(weak)]
    whole = mixed.select(F.aggregate(forest.weighted_shares(), F.lit(0.0), lambda a, b: a + b).alias("s")).distinct().collect()
    assert all(r.s == pytest.approx(1) for r in whole)


def test_drops_keep_a_feature_that_no_tree_uses(spark):
    df = spark.createDataFrame([(k, float(k % 10), 1.0, int(k % 10 < 5)) for k in range(300)], "k long, v double, same double, y int")
    forest = ensembles.grow_binned_forest(df, "k", "y", ["v", "same"], [], [0, 1], trees=4, depth=2, per_node=2)
    drops = {(r.tree, r.feature, r.repeat): r for r in forest.permuted_drops(2).collect()}
    assert len(drops) == 16 and all(r.kept == r.n and (r.dropped == r.n) == (f == "same") for (_, f, _), r in drops.items())
    left = dict(Counter(t for r in forest.rows.collect() for t in range(4) if r.w[t] == 0))
    assert {t: r.n for (t, f, k), r in drops.items() if f == "v" and k == 0} == left
    found = {r.feature: r for r in forest.permutation_importance(2).collect()}
    assert found["same"].importance == 0 and 0.2 < found["v"].importance == pytest.approx(found["v"].relative)


def test_held_out_rows_stop_boosting(spark):
    draw = random.Random(1)
    df = spark.createDataFrame([(k, float(k % 20), float(k % 20 > 9) * 4 + draw.gauss(0, 1)) for k in range(400)], "k long, v double, y double")
    model = ensembles.boost(df, "y", ["v"], rounds=40, rate=0.5, held_out=F.col("k") % 4 == 0, stop_after=3, cut_every=4)
    assert len(model.trees) == int(np.argmin(model.held)) + 1 < 40 and len(model.held) <= len(model.trees) + 4
    scored = df.where("k % 4 = 0").select("y", model.predict().alias("p")).collect()
    assert sum((r.y - r.p) ** 2 for r in scored) / len(scored) == pytest.approx(min(model.held))


def test_softmax_newton_lowers_the_loss_faster(mixed):
    plain = ensembles.boost_classes(mixed, "y", ["v", "u"], ["c"], rounds=3)
    newton = ensembles.boost_classes(mixed, "y", ["v", "u"], ["c"], rounds=3, newton=True)
    assert newton.history == sorted(newton.history, reverse=True) and newton.history[-1] < plain.history[-1]


def test_wide_trees_stop_at_unseen_values(spark):
    rows = [(k, "abc"[k % 3], float(k), int(k % 3 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, c string, v double, y int")
    tree = nary.grow_nary(df, "y", ["v"], ["c"], [0, 1], depth=3)
    shape = tree.shape().head()
    assert (shape.nodes, shape.leaves, shape.widest) == (4, 3, 3)
    new = spark.createDataFrame([(1, "a", 1.0), (2, "zzz", 1.0), (3, None, 1.0), (4, "b", None)], "k long, c string, v double")
    got = {r.k: r.shares[1] for r in tree.shares(new, "k").collect()}
    assert got == pytest.approx({1: 1.0, 2: 1 / 3, 3: 1 / 3, 4: 0.0})
    assert {r.k: r.predicted for r in tree.predict(new, "k").collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert [tuple(r) for r in tree.importance().collect()] == [("c", 1.0)]
    bad = spark.createDataFrame([(k, "abc"[k % 3], 0.0, 0) for k in range(9)], "k long, c string, v double, y int")
    assert tree.pruned(bad, "k", "y").shape().head().nodes == 1 and tree.pruned(df, "k", "y").shape().head().nodes == 4
    assert nary.grow_nary(df.where("y = 0"), "y", ["v"], ["c"], [0, 1]).shape().head().nodes == 1


def test_slim_search_makes_candidates_once_and_no_row_a_score(spark, ratings, monkeypatch):
    """Candidates are computed once, and scores of held-out ratings are summed where the models are made; pieces by user give the same."""
    rows, df = ratings
    runs = spark.sparkContext.accumulator(0)

    def pairs(batches):
        runs.add(1)
        yield from batches

    near = near_all(spark, range(12)).coalesce(1).mapInPandas(pairs, "item long, other long")
    grid = [(0.5, 1.0), (5.0, 20.0)]
    whole = {r.config: r.rmse for r in slim.search_slim(df, near, grid, 3, 1.0, 5.0)[0].collect()}
    assert runs.value == 1
    monkeypatch.setattr(slim, "PIECE", 5)
    cut = {r.config: r.rmse for r in slim.search_slim(df, near_all(spark, range(12)), grid, 3, 1.0, 5.0)[0].collect()}
    assert cut == pytest.approx(whole)


def test_forest_search_grows_its_trees_together(spark):
    """The grid's scores are those of single forests, but a search takes no more jobs than one forest of its largest depth and a pass."""
    df = spark.createDataFrame([(i, float(i * 7 % 50), float(i * 11 % 13) if i % 9 else None, "abc"[i % 3], int(i * 7 % 50 in (3, 4, 20, 21) or i % 3 == 1 and i % 2)) for i in range(300)] + [(None, 1.0, 2.0, "a", 1)], "k long, v double, u double, c string, y int")
    grid = [{"trees": n, "depth": d, "per_node": p} for n in (2, 3) for d in (1, 3) for p in (1, 2)]
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("search", "search")
    best, scores = trees.search_forest(df, "k", "y", ["v", "u"], ["c"], [0, 1], grid)
    spark.sparkContext.setJobGroup("one", "one")
    each = [trees.grow_forest(df, "k", "y", ["v", "u"], ["c"], [0, 1], **grid[-1]).oob(df, "k", "y")]
    spark.sparkContext.setJobGroup("rest", "rest")
    each = [trees.grow_forest(df, "k", "y", ["v", "u"], ["c"], [0, 1], **o).oob(df, "k", "y") for o in grid[:-1]] + each
    assert [s for _, s in scores] == each and best == grid[each.index(max(each))]
    assert jobs("search") <= jobs("one") + 2


def test_core_counts_the_rows_once_a_pass(spark):
    """What is left is that of plain passes, and the plan of the rest reads the table once, however many passes there are."""
    draw = random.Random(8)
    rows = [(draw.choice([None, *range(12)]), draw.choice([None, *range(15)]), k) for k in range(120)]
    df = spark.createDataFrame(rows, "u int, i int, k int")
    left = rows
    for _ in range(3):
        for c in (0, 1):
            n = Counter(r[c] for r in left)
            left = [r for r in left if r[c] is not None and n[r[c]] >= 6]
    found = prepare.core(df, "u", "i", 6)
    assert sorted(r.k for r in found.collect()) == sorted(r[2] for r in left) and 0 < len(left) < 120
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2


@pytest.mark.parametrize("piece", [5, 100_000])
def test_slim_in_rounds_of_items_and_users(spark, ratings, monkeypatch, piece):
    """Rounds give the models, errors and rankings of one, and send no more than SENT or all ratings at a time."""
    rows, df = ratings
    monkeypatch.setattr(slim, "PIECE", piece)
    near, grid = near_all(spark, range(12)).where("(other - item + 12) % 12 < 4"), [(0.5, 1.0), (5.0, 20.0)]
    held = spark.createDataFrame([(u, i, 1 + (u + i) % 3) for u in range(30) for i in range(12) if (u, i) not in {r[:2] for r in rows}], "user long, item long, gain int")
    key = lambda found: {tuple(r)[:-1]: pytest.approx(r.weight, abs=1e-7) for r in found.collect()}

    def results():
        scores, best = slim.search_slim(df, near, grid, 3, 1.0, 5.0)
        ranked = slim.search_slim_ranking(df, held, near, [0.5, 5.0], [1.0], 4)[0]
        return key(slim.slim_near(slim.with_folds(df, 3), near, grid, 3)), {r.config: pytest.approx(r.rmse) for r in scores.collect()}, key(best), {r.config: pytest.approx(r.ndcg) for r in ranked.collect()}

    whole, sent, sets = results(), [], slim._sets
    monkeypatch.setattr(slim, "SENT", 1)
    monkeypatch.setattr(slim, "RANKED", 400)

    def counted(*args):
        out = sets(*args)
        sent.append([each.selectExpr("sum(aggregate(sets, 0, (s, x) -> s + size(x.users))) AS n").head().n or 0 for each in out[0]])
        return out

    monkeypatch.setattr(slim, "_sets", counted)
    assert results() == whole
    assert all(len(each) == 4 and sum(each) == 4 * len(rows) and max(each) < 3 * len(rows) for each in sent)


def test_a_search_keeps_no_model_of_a_fold(spark, ratings):
    _, df = ratings
    models = slim._fitted(slim.with_folds(df, 3), near_all(spark, range(12)), [(0.5, 1.0)], 3, 200, 1e-9, 1.0, 5.0, every=False)
    assert models.where("fold >= 0 AND size(src) > 0").count() == 0 and models.where("fold < 0").count() > 0
    assert models.where("fold >= 0").select("fold").distinct().count() == 3


def test_best_unseen_in_rounds_of_users(spark, ratings, monkeypatch):
    from millrace.operators import recommend

    rows, df = ratings
    weights = spark.createDataFrame([(a, b, ((a * 5 + b) % 7) / 10) for a in range(12) for b in range(14) if a != b], "src long, dst long, weight double")
    w, seen, want = np.zeros((12, 14)), {r[:2] for r in rows}, set()
    for r in weights.collect():
        w[r.src, r.dst] = r.weight
    x = np.zeros((30, 12))
    for u, i, r in rows:
        x[u, i] = r
    for u in {r[0] for r in rows}:
        want |= {(u, i, n + 1) for n, (_, i) in enumerate(sorted((-round(float(x[u] @ w[:, i]), 6), i) for i in range(14) if (u, i) not in seen)[:3])}
    for most in (200_000_000, 300):
        monkeypatch.setattr(recommend, "ROUND_PRODUCTS", most)
        assert {(r.user, r.item, r["rank"]) for r in recommend.best_unseen(df, weights, 3, 6).collect()} == want
