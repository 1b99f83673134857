"""Every registered query against its SQL in DuckDB; those without SQL run and return rows."""

import math

import duckdb
import pytest

from millrace.plans import catalog


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.10g}"
        return x if x is None else str(int(x)) if isinstance(x, bool) else str(x)

    def number(x):
        try:
            return f"{float(x) + 0.0:.10g}"
        except (TypeError, ValueError):
            return x

    return sorted(tuple(str(number(cell(r[k]))) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), columns)


def test_cluster_accuracy_is_the_best_matching(spark):
    from itertools import permutations

    from millrace.operators import metrics

    rows = [((i * 7 + i // 3) % 4, (i * i + i // 5) % 6) for i in range(200)]
    df = spark.createDataFrame(rows + [(None, 1), (2, None)], "a int, b int")
    want = max(sum(a == dict(zip(order, range(4), strict=True)).get(b, -1) for a, b in rows) for order in permutations(range(6), 4)) / len(rows)
    assert metrics.cluster_accuracy(df, "a", "b") == metrics.cluster_accuracy(df, "b", "a") == pytest.approx(want)


def test_softmax_boosting_learns_classes(spark):
    from millrace.operators import ensembles

    rows = [(float(i % 30), "xyz"[(i % 30) // 10]) for i in range(300)] + [(1.0, None)]
    df = spark.createDataFrame(rows, "v double, label string")
    model = ensembles.boost_classes(df, "label", ["v"], rounds=4, rate=0.8)
    assert model.classes == ["x", "y", "z"] and model.history == sorted(model.history, reverse=True)
    scored = df.where("label is not null").select("label", model.predict().alias("said"), model.shares().alias("p")).collect()
    assert all(r.label == r.said and sum(r.p) == pytest.approx(1) for r in scored)


def test_grid_search_takes_the_best_score(spark):
    from millrace.operators import trees

    df = spark.createDataFrame([(i, float(i % 20), int(i % 20 in (3, 4, 5, 11, 12))) for i in range(400)], "k long, v double, y int")
    best, scores = trees.search_forest(df, "k", "y", ["v"], [], [0, 1], [{"trees": 3, "depth": d} for d in (1, 4)])
    assert best == {"trees": 3, "depth": 4} and len(scores) == 2 and scores[1][1] > scores[0][1]
