"""Factors, projections, synthetic rows, silhouettes and matchings against plain versions."""

import random
import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_bucket
from millrace.operators import ensembles, factor_blocks, metrics, oversample, projections, recommend
from millrace.operators.recommend import start_factors


@pytest.mark.parametrize("biases", [True, False])
def test_block_descent_is_one_visit_after_the_other(spark, biases):
    draw = random.Random(4)
    rows = [(u, i, float(draw.randint(1, 5))) for u in range(14) for i in range(11) if draw.random() < 0.5]
    df = spark.createDataFrame(rows, "user long, item long, rating double").repartition(3)
    b, rank, epochs = 3, 2, 2
    block = {}
    for side, seed, n in (("u", 21, 14), ("i", 22, 11)):
        block[side] = {r.id: r.b for r in spark.range(n).select("id", hash_bucket(F.col("id"), seed, b).alias("b")).collect()}
    p, q = ({r.id: np.array(r.f) for r in start_factors(spark.range(n).withColumnRenamed("id", side), side, rank, k).collect()} for k, (side, n) in enumerate((("user", 14), ("item", 11))))
    bu, bi, mean = dict.fromkeys(p, 0.0), dict.fromkeys(q, 0.0), np.mean([r for _, _, r in rows]) if biases else 0.0
    for epoch in range(epochs):
        h = {(r.user, r.item): r.h for r in df.select("user", "item", hash_bucket(F.concat_ws(":", "user", "item"), 31 + epoch, 1 << 31).alias("h")).collect()}
        for d in range(b):
            now = [r for r in rows if (block["i"][r[1]] - block["u"][r[0]]) % b == d]
            for u, i, r in sorted(now, key=lambda r: (block["u"][r[0]], h[r[0], r[1]])):
                e = r - mean - bu[u] - bi[i] - p[u] @ q[i]
                if biases:
                    bu[u], bi[i] = bu[u] + 0.1 * (e - 0.02 * bu[u]), bi[i] + 0.1 * (e - 0.02 * bi[i])
                p[u], q[i] = p[u] + 0.1 * (e * q[i] - 0.02 * p[u]), q[i] + 0.1 * (e * p[u] - 0.02 * q[i])
    got, users, items = factor_blocks.descended_factors(df, rank, epochs, rate=0.1, blocks=b, biases=biases)
    assert got == pytest.approx(mean)
    rated = {u for u, _, _ in rows}
    found = {r.id: r for r in users.collect()}
    assert set(found) == rated and all(np.allclose(found[u].f, p[u]) and found[u].bias == pytest.approx(bu[u]) for u in rated)
    assert all(np.allclose(r.f, q[r.id]) and r.bias == pytest.approx(bi[r.id]) for r in items.collect())
    new = spark.createDataFrame([(99, 1), (1, 99), (99, 99)], "user long, item long")
    scores = {(r.user, r.item): r.score for r in factor_blocks.factor_predictions(new, got, users, items).collect()}
    assert scores == pytest.approx({(99, 1): mean + bi[1], (1, 99): mean + bu[1], (99, 99): mean})


@pytest.mark.parametrize("centred", [True, False])
def test_directions_are_those_of_numpy(spark, centred):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(120, 9)) * np.array([9, 6, 4, 1, 1, 0.5, 0.3, 0.2, 0.1]) * (draw.random((120, 9)) < 0.5)
    cells = [(int(i), f"c{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    rows, names = projections.sparse_rows(spark.createDataFrame(cells, "r long, c string, v double").repartition(4), "r", "c", "v")
    assert names == [f"c{j}" for j in range(9)]
    kept = x[x.any(axis=1)]
    model = projections.principal(rows, names, 3, centred)
    y = kept - kept.mean(axis=0) if centred else kept
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(model.vectors.T @ model.vectors, vt[:3].T @ vt[:3], atol=1e-6)
    assert np.allclose(model.values, s[:3] ** 2 / (len(kept) if centred else 1), rtol=1e-6)
    assert sum(model.explained()) == pytest.approx((s[:3] ** 2).sum() / (s**2).sum(), rel=1e-6)
    got = {r.row: np.array(r.f) for r in projections.projected(rows, model).collect()}
    for i in got:
        assert np.allclose(got[i], (x[i] - (kept.mean(axis=0) if centred else 0)) @ model.vectors.T)


def test_profiles_by_hand(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "row long, f array<double>")
    ratings = spark.createDataFrame([(7, 1, 5.0), (7, 2, 1.0), (8, 3, 3.0), (8, 9, 3.0)], "user long, item long, rating double")
    mean, profiles = projections.content_profiles(ratings, items)
    assert mean == 3.0 and {r.user: r.f for r in profiles.collect()} == {7: [1.0, -2.0], 8: [0.0, 0.0]}
    pairs = spark.createDataFrame([(7, 3), (7, 9), (5, 1)], "user long, item long")
    assert {(r.user, r.item): r.score for r in projections.content_scores(pairs, mean, profiles, items).collect()} == {(7, 3): 2.0, (7, 9): 3.0, (5, 1): 3.0}


def test_neighbours_are_exact_in_one_stretch_and_recalled_in_many(spark):
    draw = np.random.default_rng(5)
    x, c = draw.normal(size=(900, 3)).round(3), draw.integers(0, 3, 900)
    df = spark.createDataFrame([(i, *map(float, v), "abc"[k]) for i, (v, k) in enumerate(zip(x, c, strict=True))], "k long, x double, y double, z double, c string")

    def plain(n):
        d = ((x[:n, None] - x[None, :n]) ** 2).sum(axis=2) + 0.25 * (c[:n, None] != c[None, :n])
        np.fill_diagonal(d, np.inf)
        return np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :5]

    few = oversample.class_neighbours(df.where("k < 200"), "k", ["x", "y", "z"], ["c"], 5, 0.25).collect()
    assert {(r.key, r["rank"]): r.other for r in few} == {(i, j + 1): int(o) for i, row in enumerate(plain(200)) for j, o in enumerate(row)}
    many = oversample.class_neighbours(df, "k", ["x", "y", "z"], ["c"], 5, 0.25, stretch=256).collect()
    found = {(r.key, r.other) for r in many}
    want = {(i, int(o)) for i, row in enumerate(plain(900)) for o in row}
    assert len(many) == 4500 and len(found & want) / len(want) > 0.95


def test_synthetic_rows_lie_between_neighbours(spark):
    draw = random.Random(6)
    rare = [(i, draw.random() * 4, draw.random(), draw.choice(["u", "v"]), "rare") for i in range(40)]
    rows = rare + [(100 + i, 50.0, 50.0, "w", "common") for i in range(140)] + [(999, None, 1.0, "u", "rare")]
    df = spark.createDataFrame(rows, "k long, a double, b double, c string, y string").repartition(3)
    made = oversample.smote(df, "k", "y", "rare", ["a", "b"], ["c"], k=4).collect()
    assert len(made) == 140 - 41 and all(r.y == "rare" and r.c in "uv" for r in made)
    ends = np.array([r[1:3] for r in rare])
    for r in made:
        p = np.array([r.a, r.b])
        gaps = [abs(np.linalg.norm(p - s) + np.linalg.norm(p - t) - np.linalg.norm(s - t)) for k, s in enumerate(ends) for t in ends[k + 1 :]]
        assert min(gaps) < 1e-9
    assert made == oversample.smote(df.repartition(5), "k", "y", "rare", ["a", "b"], ["c"], k=4).collect() or sorted(map(str, made)) == sorted(map(str, oversample.smote(df.repartition(5), "k", "y", "rare", ["a", "b"], ["c"], k=4).collect()))
    assert oversample.smote(df, "k", "y", "rare", ["a", "b"], size=7).count() == 7
    with pytest.raises(ValueError, match="fewer than two"):
        oversample.smote(df.where("y = 'common' or k = 1"), "k", "y", "rare", ["a", "b"])


def test_silhouettes_of_odd_clusters(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK", 4)
    rows = [(1, [0.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [5.0, 5.0], 1), (4, [5.0, 6.0], 1), (5, [9.0, 0.0], 2), (6, [1.0, 1.0], None), (7, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "k long, x array<double>, c long")
    known = [r for r in rows if r[2] is not None]

    def plain(power):
        out = {}
        for k, x, c in known:
            means = {}
            for e in {r[2] for r in known}:
                d = [np.linalg.norm(np.array(x) - np.array(y)) ** power for j, y, f in known if f == e and j != k]
                means[e] = np.mean(d) if d else None
            a, b = means.pop(c), min(means.values())
            out[k] = 0.0 if a is None else (b - a) / max(a, b)
        return out

    assert {r.k: r.silhouette for r in metrics.silhouette(df, "x", "c").collect()} == pytest.approx(plain(2))
    assert {r.key: r.silhouette for r in metrics.plain_silhouette(df, "k", "x", "c").collect()} == pytest.approx(plain(1))
    one = df.where("c = 0")
    assert {r.silhouette for r in metrics.silhouette(one, "x", "c").collect()} == {r.silhouette for r in metrics.plain_silhouette(one, "k", "x", "c").collect()} == {None}


def test_matching_is_the_best_of_all(spark):
    draw = np.random.default_rng(2)
    for _ in range(150):
        n, m = sorted(draw.integers(1, 7, 2).tolist())
        value = draw.integers(0, 6, (m, n)).astype(float)
        got = metrics.assignment(value)
        assert sorted(c for c in got if c >= 0) == list(range(n))
        assert sum(value[k, c] for k, c in enumerate(got) if c >= 0) == max(sum(value[order[c], c] for c in range(n)) for order in permutations(range(m), n))
    large, began = draw.integers(0, 1000, (200, 200)).astype(float), time.time()
    assert sorted(metrics.assignment(large)) == list(range(200)) and time.time() - began < 5
    many = spark.createDataFrame([(k % 40, (k + k // 400) % 40) for k in range(2000)], "a int, b int")
    assert 0.2 <= metrics.cluster_accuracy(many, "a", "b") <= 1


def test_products_in_blocks_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(8)
    p, q = draw.normal(size=(23, 3)).round(2), draw.normal(size=(31, 3)).round(2)
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, f array<double>")
    items = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(q)], "id long, f array<double>")
    seen = [(u, 100 + i) for u in range(23) for i in range(31) if (u * i) % 4 == 1] + [(5, 100 + i) for i in range(29)]
    got = {(r.user, r["rank"]): r.item for r in recommend.top_products(users, items, 4, spark.createDataFrame(seen, "user long, item long"), block=7).collect()}
    want = {}
    for u in range(23):
        fresh = sorted((-round(float(p[u] @ q[i]), 12), 100 + i) for i in range(31) if (u, 100 + i) not in set(seen))
        want |= {(u, k + 1): i for k, (_, i) in enumerate(fresh[:4])}
    assert got == want
    assert recommend.top_products(users.limit(0), items, 4).collect() == []


def test_factors_with_biases_fit_what_has_both(spark):
    draw = np.random.default_rng(3)
    a, b, bu, bi = draw.normal(size=(20, 2)), draw.normal(size=(15, 2)), draw.normal(size=20), draw.normal(size=15)
    rows = [(u, i, float(3 + bu[u] + bi[i] + a[u] @ b[i])) for u in range(20) for i in range(15) if (u + 2 * i) % 5]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    mean, users, items = recommend.als_with_biases(df, 2, 6, ridge=0.001)
    scored = factor_blocks.factor_predictions(df, mean, users, items).collect()
    assert np.mean([(r.rating - r.score) ** 2 for r in scored]) < 0.02 * np.var([r[2] for r in rows])


def test_regression_forest_by_hand(spark):
    df = spark.createDataFrame([(k, float(k % 12), float((k % 12) ** 2)) for k in range(240)], "k long, v double, y double")
    forest = ensembles.grow_binned_forest(df, "k", "y", ["v"], [], None, trees=4, depth=3, seed=2)
    rows = df.join(forest.rows.select(F.col("key").alias("k"), "w"), "k").select("y", "w", *[t.value().alias(f"t{j}") for j, t in enumerate(forest.trees)]).collect()
    pairs = [(r.y, np.mean([r[f"t{j}"] for j in range(4) if r.w[j] == 0])) for r in rows if 0 in r.w]
    y, p = np.array(pairs).T
    assert forest.oob_r2() == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and forest.oob_r2() > 0.9


def test_sums_of_ratings_that_stay_in_place(spark, monkeypatch):
    """Sums over parts that split users and items are those over all ratings; ids without factors, ratings or partners take no part."""
    from millrace.operators import meetings

    monkeypatch.setattr(meetings, "PART", 7)
    monkeypatch.setattr(meetings, "ROW", 3)
    rows = [(u, i, float((u * 5 + i * 3) % 7)) for u in range(6) for i in range(10) if (u * i + u) % 3 != 1]
    df = spark.createDataFrame([*rows, (0, 99, None), (None, 1, 2.0)], "user long, item long, rating double")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, v array<double>")
    p = spark.createDataFrame([(u, [float(u + 1)]) for u in range(1, 6)], "id long, v array<double>")
    met = meetings.Meetings(df)
    got = met.sums("user", q, p, lambda b, r, a: np.stack([b[:, 0] * r, a[:, 0] * b[:, 1]], axis=1), 2).collect()
    want = {u: (len(x), sum(i * r for i, r in x), (u + 1.0) * len(x)) for u in range(1, 6) for x in [[(i, r) for v, i, r in rows if v == u and i < 9]]}
    assert len(got) == len(want) and all((r.n, r.s0, r.s1) == pytest.approx(want[r.id]) for r in got)
    assert sorted(r.item for r in met.ids("item").collect()) == sorted({i for _, i, _ in rows})


def test_neighbours_of_wanted_rows_are_those_of_all(spark):
    """Far from zero, too, where x² + y² - 2xy keeps no digit of a distance."""
    draw = np.random.default_rng(9)
    x = draw.integers(0, 2000, (700, 2))
    df = spark.createDataFrame([(i, float(a + 10**9), float(b)) for i, (a, b) in enumerate(x.tolist())], "k long, x double, y double")
    every = oversample.class_neighbours(df, "k", ["x", "y"], [], 3, stretch=128).collect()
    some = oversample.class_neighbours(df, "k", ["x", "y"], [], 3, stretch=128, wanted=F.col("k") % 50 == 7).collect()
    assert len(some) == 14 * 3 and sorted(some) == sorted(r for r in every if r.key % 50 == 7)
    few = oversample.class_neighbours(df.where("k < 100"), "k", ["x", "y"], [], 3).collect()
    d = ((x[:100, None] - x[None, :100]) ** 2).sum(axis=2)
    np.fill_diagonal(d, 10**9)
    assert {(r.key, r["rank"]): r.other for r in few} == {(i, j + 1): int(o) for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :3]) for j, o in enumerate(row)}


def test_nothing_is_sought_for_a_class_that_lacks_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i), "u", "ab"[i % 2]) for i in range(20)], "k long, x double, c string, y string")
    monkeypatch.setattr(oversample, "numbered", None)
    assert oversample.smote(df, "k", "y", "a", ["x"], ["c"]).collect() == []


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_visits_of_a_step_give_the_numbers_of_single_visits(most):
    import pyarrow as pa

    draw = np.random.default_rng(11)
    ids = draw.integers(0, 30, (400, 2))
    ids[:60, 0] = 7  # one user in a row
    p, q, bu, bi = draw.normal(size=(30, 2)), draw.normal(size=(30, 2)), np.zeros(30), np.zeros(30)
    rating = draw.normal(size=400)
    rows = [{"kind": k, "id": i, "other": None, "rating": None, "f": f[i].tolist(), "bias": 0.0} for k, f in enumerate((p, q)) for i in range(30)]
    rows += [{"kind": 2, "id": u, "other": i, "rating": r, "f": None, "bias": None} for (u, i), r in zip(ids.tolist(), rating.tolist(), strict=True)]
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("rating", pa.float64()), ("f", pa.list_(pa.float64())), ("bias", pa.float64())])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=37)
    got = pa.Table.from_batches(list(factor_blocks._visited(2, 0.5, 0.1, 0.02, True, most)(iter(batches)))).to_pylist()
    for (u, i), r in zip(ids.tolist(), rating, strict=True):
        e = r - 0.5 - bu[u] - bi[i] - p[u] @ q[i]
        bu[u], bi[i] = bu[u] + 0.1 * (e - 0.02 * bu[u]), bi[i] + 0.1 * (e - 0.02 * bi[i])
        p[u], q[i] = p[u] + 0.1 * (e * q[i] - 0.02 * p[u]), q[i] + 0.1 * (e * p[u] - 0.02 * q[i])
    for row in got:
        f, b = ((p, bu), (q, bi))[row["kind"]]
        assert np.allclose(row["f"], f[row["id"]]) and row["bias"] == pytest.approx(b[row["id"]])
    assert len(got) == 60


def test_sums_take_few_ratings_and_no_object_a_vector(spark, monkeypatch):
    """A task holds the terms of STEP ratings and its vectors as one array, so that its memory follows from the part's size."""
    from millrace.operators import meetings

    monkeypatch.setattr(meetings, "STEP", 4)
    df = spark.createDataFrame([(u, i, float(u + i)) for u in range(6) for i in range(5)], "user long, item long, rating double")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")

    def terms(q, r, p):
        assert len(r) <= 4 and q.dtype == float
        return np.stack([q[:, 0] * r, q[:, 1]], axis=1)

    got = {r.id: (r.n, r.s0, r.s1) for r in meetings.Meetings(df).sums("user", q, None, terms, 2).collect()}
    assert got == {u: (5, float(sum(i * (u + i) for i in range(5))), 5.0) for u in range(6)}


def test_blocks_of_least_squares_grow_with_the_ratings(spark, monkeypatch):
    from millrace.operators import comparators

    blocks, real = [], comparators.ALS
    monkeypatch.setattr(comparators, "ALS_RATINGS", 9)
    monkeypatch.setattr(comparators, "ALS", lambda **o: blocks.append((o["numUserBlocks"], o["numItemBlocks"])) or real(**o))
    df = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(10) for i in range(10)], "user long, item long, rating double")
    assert comparators.compare_factors(df, df, 2, 1).count() == 2 and blocks == [(12, 12)]


def test_ratings_come_to_their_block_in_long_rows(spark, monkeypatch):
    """A block's task sorts rows of many ratings, which other tasks have put in order, equal hashes by id."""
    monkeypatch.setattr(factor_blocks, "hash_bucket", lambda key, seed, n: F.pmod(key.cast("long"), F.lit(n)) if n < 5 else F.crc32(key.cast("binary")) % 50)
    monkeypatch.setattr(factor_blocks, "SORTED", 20)
    monkeypatch.setattr(factor_blocks, "ROW", 8)
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(30) for i in range(20) if (u + i) % 3], "user long, item long, rating double")
    want = [sorted((tuple(r.f), r.bias, r.id) for r in side.collect()) for side in factor_blocks.descended_factors(df, 2, 1, blocks=2)[1:]]

    unrolled = factor_blocks._unrolled

    def rows(batches):
        for batch in batches:
            seen.add(sum(k == 2 for k in batch.column("kind").to_pylist()))
            yield from unrolled(iter([batch]))

    monkeypatch.setattr(factor_blocks, "_unrolled", rows)
    got = [sorted((tuple(r.f), r.bias, r.id) for r in side.collect()) for side in factor_blocks.descended_factors(df, 2, 1, blocks=2)[1:]]
    assert got == want and 0 < seen.value < 400 / 2


def test_steps_share_nothing_and_keep_the_order():
    draw = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 50), (400, 400)):
        u, i = draw.integers(0, n, 3000), draw.integers(0, m, 3000)
        steps = factor_blocks._steps(u, i)
        assert sorted(np.concatenate(steps).tolist()) == list(range(3000))
        at = np.empty(3000, int)
        for k, step in enumerate(steps):
            at[step] = k
            assert len(set(u[step])) == len(set(i[step])) == len(step)
        for side in (u, i):
            for x in set(side.tolist()):
                assert (np.diff(at[side == x]) > 0).all()
    assert len(factor_blocks._steps(draw.integers(0, 400, 3000), draw.integers(0, 400, 3000))) < 120
