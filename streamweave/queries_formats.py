"""Queries of readers, writers and sinks: a table is written in a format, read back, and equals the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .cli import arguments
from .plans.chain import chain
from .plans.ordered import shared_folder
from .plans.sides import taken
from .queries import QUERIES, SQL, shown, table
from .sources.readers import read
from .sources.writers import write


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def round_trip(name: str, fmt: str, source: str, cut: str, sql: str | None = None, writing: dict | None = None, as_type: str | None = None, **reading) -> None:
    """Fields of a table as files of a format, read back with numbers inferred."""

    def run(spark, sf_dir):
        path = folder(spark, name)
        write(chain(table(spark, sf_dir, source), ["cut", "-o", "-f", cut]), path, fmt, **(writing or {}))
        s = read(spark, path, as_type or fmt, infer=True, **reading)
        return shown(s)

    QUERIES[name] = run
    SQL[name] = sql or f"SELECT {cut} FROM {source}"


round_trip("read_csv", "csv", "customer", "c_custkey,c_name,c_acctbal,c_mktsegment")
round_trip("read_csv_lines_in_quotes", "csv", "documents", "doc_id,text,n_chars", "SELECT doc_id, coalesce(text, '') AS text, n_chars FROM documents", {"quote_all": True})
round_trip("read_csv_compressed", "csv", "orders", "o_orderkey,o_totalprice,o_orderpriority", writing={"compression": "gzip"})
round_trip("read_csv_separator", "csv", "part", "p_partkey,p_name,p_retailprice", writing={"fs": "semicolon"}, fs="semicolon")
round_trip("read_csv_headerless", "csv", "supplier", "s_suppkey,s_name", writing={"header": False}, header=False, fields=["s_suppkey", "s_name"])
round_trip("read_csv_ragged", "csv", "nation", "n_nationkey,n_name,n_regionkey", writing={}, ragged=True)
round_trip("read_tsv", "tsv", "customer", "c_custkey,c_name,c_acctbal")
round_trip("read_jsonl", "jsonl", "events", "event_id,user_id,event_type,value")
round_trip("read_json", "json", "lineitem", "l_orderkey,l_linenumber,l_quantity,l_returnflag")
round_trip("read_dkvp", "dkvp", "orders", "o_orderkey,o_custkey,o_orderstatus,o_totalprice")
round_trip("read_dkvpx", "dkvpx", "part", "p_partkey,p_name,p_brand")
round_trip("read_nidx", "nidx", "lineitem", "l_orderkey,l_linenumber,l_quantity", 'SELECT l_orderkey AS "1", l_linenumber AS "2", l_quantity AS "3" FROM lineitem')
round_trip("read_xtab", "xtab", "supplier", "s_suppkey,s_name,s_acctbal")
round_trip("read_pprint", "pprint", "part", "p_partkey,p_name,p_size", writing={"barred": True})
round_trip("read_markdown", "markdown", "part", "p_partkey,p_name,p_brand")
round_trip("read_dcf", "dcf", "customer", "c_custkey,c_name,c_mktsegment")
round_trip("read_recutils", "recutils", "customer", "c_custkey,c_name,c_mktsegment")
round_trip("read_yaml", "yaml", "supplier", "s_suppkey,s_name,s_acctbal")
round_trip("read_csvlite", "csvlite", "region", "r_regionkey,r_name")
round_trip("read_asv", "asv", "nation", "n_nationkey,n_name")
round_trip("read_usv", "usv", "nation", "n_nationkey,n_name")
round_trip("read_parquet", "parquet", "part", "p_partkey,p_name,p_retailprice")
round_trip("read_orc", "orc", "part", "p_partkey,p_name,p_retailprice")


def read_fixed(spark, sf_dir):
    path = folder(spark, "fixed")
    df = table(spark, sf_dir, "customer").df
    df.select(F.concat(F.rpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 30, " "), F.lpad("c_mktsegment", 12, " ")).alias("value")).write.text(path)
    return shown(read(spark, path, "fixed", infer=True, fields=["c_custkey", "c_name", "c_mktsegment"], widths=[12, 30, 12]))


def read_headers_by_file(spark, sf_dir):
    """Two part files with their fields in other orders under one path."""
    path = folder(spark, "headers")
    s = table(spark, sf_dir, "supplier")
    write(chain(s, "cut -o -f s_suppkey,s_name,s_nationkey"), path, "csv")
    write(chain(s, "cut -o -f s_nationkey,s_suppkey,s_name"), path, "csv", mode="append")
    return shown(read(spark, path, "csv", infer=True))


def tee_copy(spark, sf_dir):
    path = folder(spark, "tee")
    kept = chain(table(spark, sf_dir, "nation"), ["cut", "-o", "-f", "n_nationkey,n_name", "then", "tee", "-o", "csv", path, "then", "filter", "$n_nationkey < 5"])
    copy = read(spark, path, "csv", infer=True)
    return shown(copy).withColumn("passed", F.lit(kept.df.count()))


def split_groups(spark, sf_dir):
    path = folder(spark, "split")
    chain(table(spark, sf_dir, "orders"), ["cut", "-o", "-f", "o_orderkey,o_orderstatus,o_totalprice", "then", "split", "-g", "o_orderstatus", "--folder", path, "--prefix", "part"]).df.count()
    parts = [read(spark, f"{path}/part/part_o_orderstatus={k}", "csv", infer=True).df.select("o_orderkey", F.lit(k).alias("part")) for k in ("F", "O", "P")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def check_reads(spark, sf_dir):
    return chain(table(spark, sf_dir, "region"), "check").rows()


def command_line(spark, sf_dir):
    """A command line over a file, as ``python -m streamweave`` reads it."""
    path = folder(spark, "line")
    write(chain(table(spark, sf_dir, "orders"), "cut -o -f o_orderkey,o_orderstatus,o_totalprice"), path, "csv")
    got = arguments(["--icsv", "--ojson", "filter", '$o_orderstatus == "F"', "then", "sort", "-nr", "o_totalprice", "then", "head", "-n", "20", "then", "cut", "-x", "-f", "o_orderstatus", path])
    return shown(chain(read(spark, got["paths"][0], got["ifmt"], infer=True, **got["i"]), got["links"]))


QUERIES |= {f.__name__: f for f in (read_fixed, read_headers_by_file, tee_copy, split_groups, check_reads, command_line)}
SQL |= {
    "read_fixed": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "read_headers_by_file": "SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "tee_copy": "SELECT n_nationkey, n_name, 5 AS passed FROM nation",
    "split_groups": "SELECT o_orderkey, o_orderstatus AS part FROM orders",
    "check_reads": "SELECT * FROM region WHERE false",
    "command_line": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
}
QUERIES["read_gen"] = lambda spark, sf_dir: read(spark, "", "gen", field="i", start=1, stop=100, step=3).rows()
SQL["read_gen"] = "SELECT i FROM range(1, 101, 3) t(i)"


def split_numbered(spark, sf_dir):
    path = folder(spark, "numbered")
    chain(table(spark, sf_dir, "customer"), ["cut", "-o", "-f", "c_custkey", "then", "split", "-m", "3", "--folder", path, "--prefix", "part"]).df.count()
    parts = [read(spark, f"{path}/part/part_part={k}", "csv", infer=True).df.select("c_custkey", F.lit(k).alias("part")) for k in (1, 2, 3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


QUERIES["split_numbered"] = split_numbered
SQL["split_numbered"] = "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) % 3 + 1 AS part FROM customer"


def put_print(spark, sf_dir):
    """The lines that a program prints, for every record."""
    taken()
    chain(table(spark, sf_dir, "nation"), ["put", "-q", 'print $n_nationkey . " " . $n_name; if ($n_regionkey == 1) {printn "in "; print $n_regionkey}'])
    return spark.createDataFrame([(x.rstrip("\n"),) for x in "".join(t for _, t in taken()).splitlines()], "line string")


def put_redirects(spark, sf_dir):
    """Records told to outputs that they name themselves."""
    path = folder(spark, "redirects")
    chain(table(spark, sf_dir, "orders"), ["put", "-q", "--folder", path, 'tee > $o_orderstatus . "-part", mapselect($*, "o_orderkey", "o_totalprice")'])
    return shown(read(spark, path, "jsonl")).select("o_orderkey", "o_totalprice", "to")


def put_nested_loop(spark, sf_dir):
    program = 'm = {"a": {"x": $n_nationkey, "y": 2}, "b": {"x": $n_regionkey}}; $s = 0; for ((k1, k2), v in m) {$s += v}'
    return shown(chain(table(spark, sf_dir, "nation"), ["put", program, "then", "cut", "-o", "-f", "n_nationkey,s"]))


def put_dump_at_end(spark, sf_dir):
    """What was carried from record to record, as text at the end."""
    taken()
    chain(table(spark, sf_dir, "nation"), ["put", "-q", "@n[$n_regionkey] += 1; end {print json_encode(@n)}"])
    return spark.createDataFrame([(t.strip(),) for _, t in taken()], "line string")


QUERIES |= {f.__name__: f for f in (put_print, put_redirects, put_nested_loop, put_dump_at_end)}
SQL |= {
    "put_print": "SELECT n_nationkey || ' ' || n_name AS line FROM nation UNION ALL SELECT 'in ' || n_regionkey FROM nation WHERE n_regionkey = 1",
    "put_redirects": "SELECT o_orderkey, o_totalprice, o_orderstatus || '-part' AS \"to\" FROM orders",
    "put_nested_loop": "SELECT n_nationkey, n_nationkey + 2 + n_regionkey AS s FROM nation",
    "put_dump_at_end": "WITH c AS (SELECT n_regionkey AS k, count(*) AS n, min(n_nationkey) AS o FROM nation GROUP BY ALL) SELECT '{' || string_agg('\"' || k || '\": ' || n, ', ' ORDER BY o) || '}' AS line FROM c",
}
