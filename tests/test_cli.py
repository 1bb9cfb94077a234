"""Command lines."""

import pytest

import streamweave.operators  # noqa: F401
from streamweave.cli import arguments, main


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a,b,x\npan,p,3\neks,q,1\nwye,r,2\n")
    return str(p)


RUNS = {
    "--icsv --ojsonl sort -nr x then head -n 1 then cut -f a": '{"a":"pan"}\n',
    "--c2p sort -nf x then cut -f a,x": "a   x\neks 1\nwye 2\npan 3\n",
    "--c2l head -n 1": '{"a":"pan","b":"p","x":3}\n',
    "--icsv --oxtab head -n 1": "a pan\nb p\nx 3\n\n",
    "--c2d put '$y = $x * 2' then cut -f a,y": "a=pan,y=6\na=eks,y=2\na=wye,y=4\n",
    "--csv --ofs semicolon tac then cut -f a,b": "a;b\nwye;r\neks;q\npan;p\n",
    "--c2n --ofs - cat": "pan-p-3\neks-q-1\nwye-r-2\n",
    "--csv --headerless-csv-output sub -f a p X then head -n 1": "Xan,p,3\n",
    "--icsv --ojson filter '$x > 2' then put '$m = {\"k\": $x}' then cut -f m": '[\n{"m":{"k":"3"}}\n]\n',
    "--c2d put -q '@s += $x; end { emit @s }'": "s=6\n",
    "--icsv --omd head -n 1": "| a | b | x |\n| --- | --- | --- |\n| pan | p | 3 |\n",
}


@pytest.mark.parametrize("line", list(RUNS))
def test_run(spark, csv, capsys, line):
    import shlex

    assert main([*shlex.split(line), csv]) == 0
    assert capsys.readouterr().out == RUNS[line]


def test_generated_input(spark, capsys):
    assert main(["-n", "--ojsonl", "seqgen", "-f", "i", "--start", "1", "--stop", "3"]) == 0
    assert capsys.readouterr().out == '{"i":1}\n{"i":2}\n{"i":3}\n'


def test_arguments():
    got = arguments(["--c2j", "--ifs", ";", "--from", "x.csv", "head", "-n", "3", "then", "put", "-q", "emit @s"])
    assert got["ifmt"] == "csv" and got["ofmt"] == "json" and got["i"] == {"fs": ";"} and got["paths"] == ["x.csv"] and got["links"] == ["head", "-n", "3", "then", "put", "-q", "emit @s"]
    assert arguments(["--icsv", "nest", "--ivar", ";", "-f", "x", "a.csv", "b.csv"])["paths"] == ["a.csv", "b.csv"]
    for bad in (["--frob", "cat"], ["--icsv", "frob"], ["--icsv"]):
        with pytest.raises(ValueError):
            arguments(bad)


def test_more_flags(spark, tmp_path, capsys):
    def run(line, text, name="in.txt"):
        p = tmp_path / name
        p.write_text(text)
        assert main([*line, str(p)]) == 0
        return capsys.readouterr().out

    assert run(["--idkvp", "--ojsonl", "--irs", ";", "cat"], "a=1,b=2;a=3,b=4;") == '{"a":1,"b":2}\n{"a":3,"b":4}\n'
    assert run(["--idkvp", "--ojsonl", "--ifs-regex", "[;|]+", "--ips-regex", "[:=]", "cat"], "a=1;|b:2\n") == '{"a":1,"b":2}\n'
    assert run(["--idkvp", "--ojsonl", "--repifs", "cat"], "a=1,,,b=2\n") == '{"a":1,"b":2}\n'
    assert run(["--inidx", "--ojsonl", "--ifs-regex", "[ ;]+", "cat"], "x; y\n") == '{"1":"x","2":"y"}\n'
    assert run(["--icsv", "--ojsonl", "--pass-comments", "cat"], "#note\na\n1\n") == '#note\n{"a":1}\n'
    assert run(["--icsv", "--ocsv", "--flatsep", ":", "put", '$m = {"k": {"j": 1}}'], "a\n1\n").splitlines()[0].startswith("a,m:k")
    (tmp_path / "lib.prog").write_text("func twice(x) {return 2 * x}\n")
    assert run(["--icsv", "--ojsonl", "--load", str(tmp_path / "lib.prog"), "put", "$b = twice($a)"], "a\n4\n") == '{"a":4,"b":8}\n'
    assert run(["--icsv", "--ocsv", "--records-per-batch", "10", "--nr-progress-mod", "5", "put", 'print "seen ".$a'], "a\n4\n") == "seen 4\na\n4\n"
    p = tmp_path / "place.csv"
    p.write_text("a\n3\n1\n")
    assert main(["-I", "--csv", "sort", "-nf", "a", str(p)]) == 0 and p.read_text() == "a\n1\n3\n"
