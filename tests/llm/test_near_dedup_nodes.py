"""Where classes are placed below large nodes."""

import pytest

from millrace.llm import near_dedup


@pytest.mark.parametrize("at_a_time", [1, 3, 1000])
def test_nodes_follow_from_signatures_without_joins(spark, monkeypatch, at_a_time):
    plans, real = [], near_dedup.written

    def seen(df):
        if df.columns == ["node", "rep", "size"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "LARGE_NODES", at_a_time, raising=False)
    monkeypatch.setattr(near_dedup, "written", seen)
    base = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join([*base, *(f"u{i}_{j}" for j in range(1 + i % 4))])) for i in range(30)] + [(100 + i, f"other {i} text of its own w{i}") for i in range(30)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 100 else i for i, _ in rows}
    assert len(plans) == 2 and not any("Join" in p for p in plans)
