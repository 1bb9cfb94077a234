"""Chains over streaming inputs give what they give over the same rows at rest."""

import pytest

import streamweave.operators  # noqa: F401
from streamweave.plans.chain import chain
from streamweave.plans.stream import Stream
from streamweave.streaming import live, sessions, stateful_steps, stats_by_time


@pytest.fixture
def feed(spark, tmp_path):
    """A directory of files as a stream, one file a batch."""
    def run(rows, schema, parts=2):
        df = spark.createDataFrame(rows, schema)
        for i in range(parts):
            spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return run


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return [r.asDict() for r in spark.sql(f"SELECT * FROM {name}").collect()]
    finally:
        q.stop()


ROWS = [(i, f"g{i % 3}", float(i * i % 17)) for i in range(40)]


def test_records(spark, feed):
    rest, flow = feed(ROWS, "k long, g string, v double")
    links = "filter '$v > 3' then put '$w = $v * 2; $t = $g . \"!\"' then cut -x -f v"
    want = [r.asDict() for r in chain(Stream(rest), links).rows().collect()]
    key = lambda r: sorted(map(str, r.items()))
    assert sorted(drain(spark, live(flow, links), "records", "append"), key=key) == sorted(want, key=key)


def test_aggregates(spark, feed):
    rest, flow = feed(ROWS, "k long, g string, v double")
    got = {r["g"]: r for r in drain(spark, live(flow, "filter '$v > 3' then stats1 -a count,mean,max -f v -g g"), "aggregates", "complete")}
    want = {r["g"]: r.asDict() for r in chain(Stream(rest), "filter '$v > 3' then stats1 -a count,mean,max -f v -g g").rows().collect()}
    assert {g: (r["v_count"], round(r["v_mean"], 9), r["v_max"]) for g, r in got.items()} == {g: (r["v_count"], round(r["v_mean"], 9), r["v_max"]) for g, r in want.items()}


def test_verbs_that_need_the_end(spark, feed):
    _, flow = feed(ROWS, "k long, g string, v double")
    for links in ("tac", "sort -f g then cat", "stats1 -a count -f v then cat", "rank -f v"):
        with pytest.raises(ValueError):
            live(flow, links)


def test_event_time(spark, feed):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=i), "a" if i % 2 else "b", float(i)) for i in range(30)]
    _, flow = feed(rows, "t timestamp, g string, v double", parts=1)
    got = drain(spark, stats_by_time(flow, ["count", "max"], ["v"], "t", "10 minutes", "1 hour", by=("g",)), "by_time", "update")
    assert sum(r["v_count"] for r in got) == 30 and len(got) == 6 and max(r["v_max"] for r in got) == 29


def test_sessions(spark, feed):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), "a") for m in (0, 1, 2, 30, 31)]
    _, flow = feed(rows, "t timestamp, g string", parts=1)
    got = drain(spark, sessions(flow, "g", "t", "5 minutes", "0 minutes"), "sessions", "complete")
    assert sorted(r["count"] for r in got) == [2, 3]


def test_steps_go_on_between_batches(spark, feed):
    rows = [(i, "a", float(i + 1)) for i in range(6)]
    _, flow = feed([*rows[0::2], *rows[1::2]], "k long, g string, v double", parts=1)
    got = drain(spark, stateful_steps(flow, "g", "k", "v"), "steps", "append")
    assert [(r["v_delta"], r["v_rsum"], r["v_counter"]) for r in sorted(got, key=lambda r: r["k"])] == [(0.0, 1.0, 1), (1.0, 3.0, 2), (1.0, 6.0, 3), (1.0, 10.0, 4), (1.0, 15.0, 5), (1.0, 21.0, 6)]
