"""Queries with SQL against DuckDB; long URLs."""

import math
import os
import time

import duckdb
import pytest

from millrace.llm import queries, urls


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_is_its_sql(name, spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    cell = lambda x: f"{x:.10g}" if isinstance(x, float) else str(x)
    plain = lambda rows, names: sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_long_urls_cost_in_proportion(spark):
    rows = [(k, f"http://news{k % 7}.example.org/fr/story-{k}", None) for k in range(60)] + [(100 + k, f"http://x{k % 7}.example.com/de/pills-{k}", None) for k in range(60)]
    rows += [(500, "http://long.net/" + "é/x1" * 50_000, None), (500, "http://long.net/" + "é/x1" * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, score string")
    began = time.time()
    got = urls.filter_urls(df).collect()
    assert time.time() - began < 60 and len(got) == len(rows)
    long = [r for r in got if r.page_id == 500]
    assert len(long) == 2 and long[0].score == long[1].score and math.isfinite(long[0].score) and len(long[0].path) == 200_001
