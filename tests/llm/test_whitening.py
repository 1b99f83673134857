"""Whitening against numpy over the collected vectors."""

import math

import duckdb
import numpy as np
import pytest

from millrace.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def plain(rows, k=4):
    """(vec_id, component) -> deviation, |whitened|, explained, and n; by numpy over all vectors at once."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in good), default=0)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in good:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True))
        for c, v in enumerate(values):
            out.append((i, c + 1, n, deviation, abs((np.array(x) - total / n) @ vectors[:, c] / math.sqrt(v)) if v > 1e-9 else None, v / values.sum() if k >= width else v / np.trace(centred.T @ centred / n)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4] or 0)
    got = sorted([(r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained) for r in got], key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4:] == pytest.approx(w[4:], rel=1e-6, abs=1e-7)


def test_query(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    df = queries.op12_whiten(spark, sf)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.collect()
    same(got, plain(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    white = np.array([[r.whitened for r in got if r.component == c] for c in (1, 2)])
    assert white.shape[1] == len(rows)


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(200)] + [(3, rows[4][1]), (None, rows[5][1]), (None, None)]  # copies count once
    rows += [(400, None), (401, [1.0, None, 2.0, 0.0, 1.0]), (402, [float("nan")] * 5), (403, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (404, []), (405, [1.0, -2.0])]
    df = spark.createDataFrame([(*r, 1, "extra", 2, "c") for r in rows], SCHEMA).repartition(5)
    same(whitening.whiten(df).collect(), plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(*r, 1, "", 1, "") for r in rows], SCHEMA)).collect() == []


def test_without_variance(spark):
    df = spark.createDataFrame([(i, [1.5, 2.0], 1, "", 1, "") for i in range(3)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 6
    one = spark.createDataFrame([(i, [float(i), 1.0], 1, "", 1, "") for i in range(4)], SCHEMA)
    got = whitening.whiten(one).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 3.0]), (2, [-1e12, 4.0]), (3, [5.0, 6.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame([(i, v, 1, "", 1, "") for i, v in rows], SCHEMA)).collect()}
    assert got == {1: None, 2: None, 3: got[3]}
    rows = [(1, [1e6, 3.0]), (2, [-1e6, 4.0]), (3, [5.0, 6.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "", 1, "") for i, v in rows], SCHEMA)).collect()
    same(got, plain([(i, np.array(v, np.float32).tolist()) for i, v in rows]))


def test_merging_is_the_same_in_any_order():
    draw = np.random.default_rng(1)
    x = draw.integers(-300, 300, (50, 6))
    whole = whitening._summary(x, x.astype(float))
    parts = [whitening._summary(p, p.astype(float)) for p in np.split(x, [1, 7, 30])]
    left = whitening.merged(whitening.merged(whitening.merged(parts[3], parts[1]), parts[0]), parts[2])
    assert left.n == whole.n and left.sums == whole.sums and left.low == whole.low and left.high == whole.high
    assert np.allclose(left.mean, whole.mean) and np.allclose(left.scatter, whole.scatter)
