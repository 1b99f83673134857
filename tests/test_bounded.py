"""What is shuffled, written and held by queries that grew faster than their input."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, prepare, recommend


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_gram_of_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(recommend, "GRAM_RATINGS", 20)
    monkeypatch.setattr(recommend, "GRAM_PRODUCTS", 30)
    draw = np.random.default_rng(3)
    name = (lambda i: int(i)) if kind == "long" else (lambda i: f"i{i}")
    cells = {(int(u), name(i)): float(draw.integers(0, 5)) for u in range(60) for i in range(12) if i == 4 or draw.random() < 0.3}  # item 4 has more ratings than a block
    want = defaultdict(float)
    for (u, i), x in cells.items():
        for (v, j), y in cells.items():
            if u == v:
                want[i, j] += x * y
    rows = [(u, i, x) for (u, i), x in cells.items()] + [(None, name(1), 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, f"user long, item {kind}, rating double").repartition(3)
    found = recommend.gram(df).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.g for r in found} == pytest.approx(want)
    monkeypatch.setattr(recommend, "GRAM_RATINGS", 1000)
    whole = recommend.gram(df)
    assert "hashpartitioning(a" not in plan_of(whole) and {(r.a, r.b): r.g for r in whole.collect()} == pytest.approx(want)


def test_scores_go_to_their_user_once(spark, monkeypatch):
    monkeypatch.setattr(recommend, "SCORED", 40)
    draw = np.random.default_rng(5)
    cells = {(u, i): float(draw.integers(1, 6)) for u in range(30) for i in range(15) if draw.random() < 0.4}
    weights = [(i, (i * 7 + k * 3) % 18, 1.0 / (k + 1)) for i in range(14) for k in range(3)]
    want = defaultdict(float)
    for (u, i), x in cells.items():
        for src, dst, w in weights:
            if src == i:
                want[u, dst] += x * w
    r = spark.createDataFrame([(u, i, x) for (u, i), x in cells.items()], "user long, item long, rating double").repartition(3)
    w = spark.createDataFrame(weights, "src long, dst long, weight double")
    scores = recommend.marked_scores(r, w, r)
    rows = scores.collect()
    assert {(x.user, x.item): x.score for x in rows} == pytest.approx(want) and all(x.marked == ((x.user, x.item) in cells) for x in rows)
    assert {(x.user, x.item): x.score for x in recommend.linear_scores(r, w).collect()} == pytest.approx(want)
    marked = scores.withColumn("score", F.round("score", 6))
    best = recommend.explore_and_exploit(marked, None, 5, 2)
    same = recommend.explore_and_exploit(marked.drop("marked"), r, 5, 2)
    plan = plan_of(best)
    assert "hashpartitioning(user" in plan and not any("item" in line for line in plan.splitlines() if "hashpartitioning(user" in line)
    got = sorted((x.user, x.rank, x.item) for x in best.collect())
    assert got == sorted((x.user, x.rank, x.item) for x in same.collect())
    for u in range(30):
        order = sorted((-round(s, 6), i) for (v, i), s in want.items() if v == u)
        kept = sorted({*order[:3], *[x for x in order if (u, x[1]) not in cells][:2]})
        assert [i for v, _, i in got if v == u] == [i for _, i in kept]


def test_pairs_of_points_meet_once(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SMALL_BLOCK", 20)
    draw = np.random.default_rng(8)
    x, c = draw.normal(size=(90, 9)), draw.integers(0, 3, 90)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "k long, x array<double>, c int")
    got = {r.key: r.silhouette for r in metrics.plain_silhouette(df, "k", "x", "c").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(90):
        means = [d[i][(c == k) & (np.arange(90) != i)].mean() for k in range(3)]
        a, b = means[c[i]], min(m for k, m in enumerate(means) if k != c[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_terms_are_weighed_where_their_text_is(spark, monkeypatch):
    monkeypatch.setattr(prepare, "DOC_BYTES", 200)
    texts = {d: " ".join("abcdefgh"[(d * k) % 8] * 2 for k in range(d % 5 + 1)) for d in range(40)}
    rows = [(d, t) for d, t in texts.items()] + [(3, "zz aa"), (41, None), (42, "")]  # a document of two rows
    df = spark.createDataFrame(rows, "d long, t string").repartition(3)
    out = prepare.tfidf(df, "d", "t", 2)
    plan = plan_of(out)
    assert plan.count("hashpartitioning(doc") == 1
    counts = defaultdict(lambda: defaultdict(int))
    for d, t in rows:
        for term in (t or "").split():
            counts[d][term] += 1
    have = defaultdict(int)
    for c in counts.values():
        for term in c:
            have[term] += 1
    got = {(r.doc, r.term): r.weight for r in out.collect()}
    want = {}
    for d, c in counts.items():
        x = {term: k * (np.log((1 + 42) / (1 + have[term])) + 1) for term, k in c.items() if have[term] >= 2}
        want |= {(d, term): v / np.sqrt(sum(y * y for y in x.values())) for term, v in x.items()}
    assert got == pytest.approx(want)


def test_biased_factors_do_not_join_ratings(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("ratings are joined with factors")

    for name in ("factor_scores", "solved", "refreshed_biases"):
        monkeypatch.setattr(recommend, name, joined)
    cells = [(u, i, float((u * i) % 5)) for u in range(6) for i in range(5) if (u + i) % 3]
    mean, users, items = recommend.als_with_biases(spark.createDataFrame(cells, "user long, item long, rating double"), 2, 0)
    assert mean == pytest.approx(np.mean([x for _, _, x in cells]))
    bu = {u: np.mean([x - mean for v, _, x in cells if v == u]) for u in range(6)}
    assert {r.id: r.bias for r in users.collect()} == pytest.approx(bu)
    assert {r.id: r.bias for r in items.collect()} == pytest.approx({i: np.mean([x - mean - bu[u] for u, j, x in cells if j == i]) for i in range(5)})
