"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line of seconds, warm session, best of two."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

CHAINS = {
    "cat": ("lineitem", "cat"),
    "filter": ("lineitem", "filter '$l_quantity > 45 && $l_returnflag == \"R\"'"),
    "stats1": ("lineitem", "stats1 -a min,mean,max -f l_quantity,l_extendedprice -g l_returnflag,l_linestatus"),
    "percentiles": ("lineitem", "stats1 -a p10,p50,p90 -f l_extendedprice -g l_returnflag,l_linestatus"),
    "sort_f": ("lineitem", "sort -f l_returnflag"),
    "sort_nr": ("lineitem", "sort -nr l_extendedprice"),
    "tac": ("lineitem", "tac"),
    "top_group": ("lineitem", "top -n 10 -f l_extendedprice -g l_returnflag -a"),
    "step": ("lineitem", "step -a delta,shift,rsum -f l_extendedprice -g l_returnflag,l_linestatus,l_suppkey"),
    "join": ("lineitem", "join -f O -j o_orderkey -r l_orderkey --lk o_custkey,o_totalprice"),
    "count_distinct": ("lineitem", "count-distinct -f l_partkey,l_suppkey then count"),
    "reshape_long": ("lineitem", "cut -f l_orderkey,l_linenumber,l_discount,l_tax then reshape -i l_discount,l_tax -o k,v"),
    "reshape_wide": ("lineitem", "count -g l_shipdate,l_returnflag then reshape -s l_returnflag,count"),
    "put_chain1": ("lineitem", "put '$net = $l_extendedprice * (1 - $l_discount); $tag = $l_returnflag . \"_\" . $l_linestatus'"),
    "put_chain4": ("lineitem", " then ".join(f"put '$v{i} = $l_extendedprice * {i} + $l_tax'" for i in range(1, 5))),
    "put_local": ("lineitem", "put 'var t = $l_extendedprice * $l_discount; $d = t + 1; $e = t * t'"),
    "put_udf": ("lineitem", "put 'func f(num a, num b): num { if (a > b) { return a * b } return a - b } $u = f($l_quantity, 25) + f($l_tax, 0.05)'"),
    "emit_grouped": ("lineitem", "put -q '@s[$l_returnflag][$l_linestatus] += $l_quantity; end { emit @s, \"flag\", \"status\" }'"),
    "merge_fields": ("lineitem", "merge-fields -k -a sum,max -f l_quantity,l_extendedprice -o ab"),
    "clean_whitespace": ("documents", "clean-whitespace -v"),
}


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from streamweave.plans.chain import chain
    from streamweave.plans.stream import Stream
    import streamweave.operators  # noqa: F401

    def table(name: str) -> Stream:
        """A table in the order in which it is read, as a file's records come."""
        return Stream.of(spark.read.parquet(f"{sf}/{name}.parquet"))

    orders = table("orders")
    took = {}
    for name, (source, links) in CHAINS.items():
        best = None
        for _ in range(3):  # the first also warms up
            t = time.time()
            out = chain(table(source), links, O=orders)
            out.sorted().write.format("noop").mode("overwrite").save()
            s = time.time() - t
            best = s if best is None else min(best, s)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, sum of best times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
