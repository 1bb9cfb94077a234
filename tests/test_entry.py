"""The driver's contract, and that the library stands without the llm folders."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "l_extendedprice_count", "l_extendedprice_sum", "l_extendedprice_mean"] and df.count() >= 3


def test_sql_is_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    for name in ("streamweave", "__spark_entry__.py"):
        src = os.path.join(HERE, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "streamweave" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    assert int(said.stdout.split()[0]) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")
@pytest.mark.parametrize("name", ["stats1_modes", "step_steppers", "join_full", "emit_grouped", "functions_string", "summary", "histogram"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    clean = lambda v: "~" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    a = sorted(tuple(map(clean, r)) for r in got.select(*[f"`{n}`" for n in names]).collect())
    assert a == sorted(tuple(map(clean, r)) for r in want.fetchall())
