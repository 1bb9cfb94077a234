"""Running values over a placed stream are those of one window."""

import pytest

import streamweave.operators  # noqa: F401
from streamweave.plans import ordered
from streamweave.plans.chain import chain
from streamweave.plans.stream import Stream

CHAINS = [
    "cat -n", "fill-down -f x", "fill-down -a -f x", "fraction -c -f v", "decimate -n 7", "tail -n +60", "step -a rsum,counter -f v", "sort -nr v then cat -N n", "tac then fill-down -f x", "put '$k = NR * 2'", "filter 'NR > 90'",
    "step -a shift,shift_lead,delta,ratio -f v", "step -a delta_3,shift_lag_2,shift_lead_4 -f v", "step -a slwin_2_3 -f v", "step -a from-first,rprod -f v", "rank -f v,x", "fraction -f v", "fraction -p -f v", "gap -n 10", "gap -g x",
    "sort -nr v then step -a shift,delta -f k", "top -n 3 -f v -g x",
]


@pytest.mark.parametrize("links", CHAINS)
def test_placed(spark, monkeypatch, links):
    rows = [(i, (i * 37) % 101, None if i % 4 else "" if i % 8 == 4 else f"x{i}") for i in range(100)]
    s = Stream.of(spark.createDataFrame(rows, "k int, v int, x string").repartition(5), "k")
    want = sorted(map(str, chain(s, links).rows().collect()))
    monkeypatch.setattr(ordered, "LARGE", 0)
    monkeypatch.setattr(ordered, "TOGETHER", 8)
    assert sorted(map(str, chain(s, links).rows().collect())) == want


@pytest.mark.parametrize("links", ["step -a shift,delta,slwin_1_1 -f v", "rank -f v", "fraction -f v", "gap -n 10", "cat -n"])
def test_no_window_over_all_rows(spark, monkeypatch, links):
    """Beyond the size for one task, no plan gathers all rows in one partition."""
    s = Stream.of(spark.range(1000).selectExpr("id AS k", "id % 7 AS v"), "k")
    monkeypatch.setattr(ordered, "LARGE", 0)
    plan = chain(s, links).df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "SinglePartition" in x]
    assert all("Aggregate" in x for x in below), plan  # what is gathered is one row a partition


def test_what_lies_as_it_was_scanned_is_not_sorted(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS g").repartition(5).write.parquet(str(tmp_path / "t"))
    s = Stream.of(spark.read.parquet(str(tmp_path / "t")))
    before = [r.id for r in s.rows().collect()]
    kept = chain(s, "filter '$g != 3' then put '$z = $id + 1' then cut -f id,z")
    assert "Sort" not in kept.sorted()._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in kept.sorted().collect()] == [i for i in before if i % 7 != 3]
    for links in ("tac", "sort -nf id", "count-similar -g g", "step -a shift -f id"):
        out = chain(s, links)
        assert not out.as_scanned() and out.sorted().count() == 1000
