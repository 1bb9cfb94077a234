"""Readers and writers: what is written reads back, and the rules of each format."""

import gzip
import glob

import pytest

import streamweave.operators  # noqa: F401
from streamweave.plans.chain import chain
from streamweave.sources.readers import read, typed
from streamweave.sources.writers import render, text_of, write


@pytest.fixture
def put(tmp_path):
    def run(name, text):
        p = tmp_path / name
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(p)

    return run


def rows(s):
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in s.sorted().collect()]


ABC = [{"a": "1", "b": "x", "c": "3"}, {"a": "4", "b": "", "c": "6"}]

INPUTS = {
    "csv": ("a,b,c\n1,x,3\n4,,6\n", {}, ABC),
    "csv quotes": ('a,b\n"x,1","he said ""hi"""\n"two\nlines",z\n', {}, [{"a": "x,1", "b": 'he said "hi"'}, {"a": "two\nlines", "b": "z"}]),
    "csv headerless": ("1,x\n2,y\n", {"header": False}, [{"1": "1", "2": "x"}, {"1": "2", "2": "y"}]),
    "csv semicolon": ("a;b\n1;2\n", {"fs": "semicolon"}, [{"a": "1", "b": "2"}]),
    "csv comments": ("#top\na,b\n1,2\n#mid\n3,4\n", {"comments": "#"}, [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]),
    "csv ragged": ("a,b,c\n1,2\n3,4,5,6\n", {"ragged": True}, [{"a": "1", "b": "2"}, {"a": "3", "b": "4", "c": "5", "4": "6"}]),
    "csvlite": ("a,b\n1,2\n\nc\n3\n", {}, [{"a": "1", "b": "2"}, {"c": "3"}]),
    "tsv": ("a\tb\nx\\ty\t1\\n2\n", {}, [{"a": "x\ty", "b": "1\n2"}]),
    "json": ('[{"a": 1, "b": {"x": 2}}, {"a": 3}]', {}, None),
    "jsonl": ('{"a": "1"}\n{"b": "2"}\n', {}, [{"a": "1"}, {"b": "2"}]),
    "dkvp": ("a=1,b=2\nc=3,a=\nxyz,b=4\n", {}, [{"a": "1", "b": "2"}, {"a": "", "c": "3"}, {"1": "xyz", "b": "4"}]),
    "dkvp repeated": ("a=1,a=2,a=3\n", {}, [{"a": "1", "a_2": "2", "a_3": "3"}]),
    "dkvpx": ('a="x,1",b=2\n', {}, [{"a": "x,1", "b": "2"}]),
    "nidx": ("the  quick fox\na b\n", {}, [{"1": "the", "2": "quick", "3": "fox"}, {"1": "a", "2": "b"}]),
    "xtab": ("a   1\nbcd x y\n\na   2\n", {}, [{"a": "1", "bcd": "x y"}, {"a": "2"}]),
    "pprint": ("a   b\n1   -\n22  x\n\nc\n5\n", {}, [{"a": "1", "b": ""}, {"a": "22", "b": "x"}, {"c": "5"}]),
    "pprint barred": ("+---+---+\n| a | b |\n+---+---+\n| 1 | x |\n+---+---+\n", {}, [{"a": "1", "b": "x"}]),
    "markdown": ("| a | b |\n| --- | --- |\n| 1 | x |\n", {}, [{"a": "1", "b": "x"}]),
    "dcf": ("Package: p\nDepends: a,\n b\n\nPackage: q\n", {}, [{"Package": "p", "Depends": "a, b"}, {"Package": "q"}]),
    "recutils": ("# c\nName: x\nNote: one\n+ two\n\nName: y\n", {}, [{"Name": "x", "Note": "one\ntwo"}, {"Name": "y"}]),
    "yaml": ("---\na: 1\nb: 'x'\n---\na: 2\n", {}, [{"a": "1", "b": "x"}, {"a": "2"}]),
    "yaml list": ("- a: 1\n  b: x\n- a: 2\n", {}, [{"a": "1", "b": "x"}, {"a": "2"}]),
    "asv": ("a\x1fb\x1e1\x1f2\x1e", {}, [{"a": "1", "b": "2"}]),
    "usv": ("a␟b␞1␟2␞", {}, [{"a": "1", "b": "2"}]),
    "fixed": ("ab 12\ncd  3\n", {"fields": ["k", "v"], "widths": [3, 2]}, [{"k": "ab", "v": "12"}, {"k": "cd", "v": "3"}]),
}


@pytest.mark.parametrize("name", list(INPUTS))
def test_reader(spark, put, name):
    text, options, want = INPUTS[name]
    fmt = name.split()[0]
    s = read(spark, put(f"in.{fmt}", text), fmt, **options)
    if fmt == "json":
        got = s.sorted().collect()
        assert got[0].a == 1 and got[0].b.x == 2 and got[1].b is None
    else:
        assert rows(s) == want


def test_suffixes_and_codecs(spark, put):
    p = put("in.csv.gz", gzip.compress(b"a,b\n1,2\n"))
    assert rows(read(spark, p)) == [{"a": "1", "b": "2"}]


def test_several_files_in_their_order(spark, put):
    a, b = put("z.csv", "a\n1\n2\n"), put("y.csv", "a,b\n3,4\n")
    assert rows(read(spark, [a, b])) == [{"a": "1"}, {"a": "2"}, {"a": "3", "b": "4"}]


def test_each_file_of_a_path_has_its_own_header(spark, put, tmp_path):
    for fmt, sep in (("csv", ","), ("tsv", "\t")):
        (tmp_path / fmt).mkdir()
        for name, text in {"1": "a,b\n1,2\n", "2": "b,a\n3,4\n", "3": "a,b\n5,6\n7,8\n", "4": "", "5": "a,b\n9,10\n"}.items():
            (tmp_path / fmt / f"part {name}.{fmt}").write_text(text.replace(",", sep))
        want = [{"a": "1", "b": "2"}, {"a": "4", "b": "3"}, {"a": "5", "b": "6"}, {"a": "7", "b": "8"}, {"a": "9", "b": "10"}]
        assert rows(read(spark, str(tmp_path / fmt), fmt)) == want
        assert rows(read(spark, str(tmp_path / fmt), fmt, ragged=True)) == want


def test_ragged_rows_of_any_length(spark, put):
    long = ",".join(str(i) for i in range(100))
    got = rows(read(spark, put("in.csv", f'a,b\n{long}\n1\n"x,1","say ""hi"""\n'), ragged=True))
    assert [len(r) for r in got] == [100, 1, 2] and got[0]["100"] == "99" and got[2] == {"a": "x,1", "b": 'say "hi"'}


def test_large_files_are_split(spark, put):
    text = "a,b\n" + "".join(f"{i},{'x' * 40}\n" for i in range(60000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400000")
    try:
        s = read(spark, put("in.csv", text))
        assert s.df.rdd.getNumPartitions() > 4 and [r.a for r in s.sorted().collect()] == [str(i) for i in range(60000)]
        many = read(spark, put("many.csv", 'a,b\n1,"x\ny"\n'))
        assert rows(many) == [{"a": "1", "b": "x\ny"}]
        j = read(spark, put("in.json", "".join(f'{{"a": {i}}}\n' for i in range(60000))), "json")
        assert j.df.rdd.getNumPartitions() > 1 and j.df.count() == 60000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rules_of_csv_and_tsv(spark, put):
    assert rows(read(spark, put("in.csv", "a,a,b\n1,2,3\n"))) == [{"a": "1", "a_2": "2", "b": "3"}]
    assert rows(read(spark, put("in2.csv", "%%note\na,b\n1,2\n%%other\n3,4\n"), comments="%%")) == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert rows(read(spark, put("in3.csv", "\ufeffa,b\n1,2\n"))) == [{"a": "1", "b": "2"}]
    assert rows(read(spark, put("in.tsv", "a\tb\n1\n2\t3\t4\n"), ragged=True)) == [{"a": "1"}, {"a": "2", "b": "3", "3": "4"}]
    assert rows(read(spark, put("in4.csv", "1;2\n3;4\n"), header=False, fields=["x", "y"], fs="semicolon")) == [{"x": "1", "y": "2"}, {"x": "3", "y": "4"}]
    assert rows(read(spark, put("empty.csv", ""))) == []


def test_inference(spark, put):
    s = typed(read(spark, put("in.csv", "i,f,t,h,e,z\n1,1.5,x,0xff,,007\n2,3,4,0x10,5,1\n")))
    assert {c: s.dtype(c).simpleString() for c in s.columns} == {"i": "bigint", "f": "double", "t": "string", "h": "bigint", "e": "bigint", "z": "string"}
    assert rows(s)[0] == {"i": 1, "f": 1.5, "t": "x", "h": 255, "z": "007"}


@pytest.mark.parametrize("fmt", ["csv", "tsv", "jsonl", "dkvp", "dkvpx", "xtab", "markdown", "pprint", "dcf", "recutils", "yaml", "csvlite", "parquet", "orc"])
def test_round_trip(spark, put, tmp_path, fmt):
    s = read(spark, put("in.csv", "a,b,c\n1,x y,3\n4,v,6\n5,w;,7\n"))
    out = str(tmp_path / f"out.{fmt}")
    write(chain(s, "sort -nr a"), out, fmt, **({"barred": True} if fmt == "pprint" else {}))  # bars keep blanks within a value
    back = read(spark, out, fmt)
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(s)))


def test_texts(spark, put):
    s = read(spark, put("in.csv", "a,bcd\n1,\n22,\"x,y\"\n"))
    assert text_of(s, "csv") == 'a,bcd\n1,\n22,"x,y"\n'
    assert text_of(s, "tsv") == "a\tbcd\n1\t\n22\tx,y\n"
    assert text_of(s, "dkvp") == "a=1,bcd=\na=22,bcd=x,y\n"
    assert text_of(s, "nidx") == "1 \n22 x,y\n"
    assert text_of(s, "pprint") == "a  bcd\n1  -\n22 x,y\n"
    assert text_of(s, "pprint", barred=True).splitlines()[1:4:2] == ["| a  | bcd |", "| 1  | -   |"]
    assert text_of(s, "markdown") == "| a | bcd |\n| --- | --- |\n| 1 |  |\n| 22 | x,y |\n"
    assert text_of(s, "jsonl") == '{"a":"1","bcd":""}\n{"a":"22","bcd":"x,y"}\n'
    assert text_of(s, "xtab") == "a   1\nbcd \n\na   22\nbcd x,y\n\n"
    assert render(s, "csv").count() == 3


def test_split_and_tee(spark, put, tmp_path):
    s = read(spark, put("in.csv", "g,v\nx,1\ny,2\nx,3\n"))
    assert rows(chain(s, ["split", "-g", "g", "--folder", str(tmp_path), "--prefix", "p"])) == []
    parts = {f.split("p_g=")[1].split("/")[0]: open(f).read() for f in glob.glob(f"{tmp_path}/p/*/part-*")}
    assert parts == {"x": "g,v\nx,1\nx,3\n", "y": "g,v\ny,2\n"}
    assert len(rows(chain(s, ["tee", "-o", "csv", f"{tmp_path}/copy"]))) == 3
    assert rows(read(spark, f"{tmp_path}/copy", "csv")) == rows(s)


def test_unknown_format(spark, put):
    with pytest.raises(ValueError):
        read(spark, put("in.x", ""), "frob")


def stanza_text(fmt, stanzas):
    """Header and rows of each stanza, in a format whose records stand below their header."""
    line = {"csvlite": ",".join, "pprint": " ".join, "markdown": lambda c: f"| {' | '.join(c)} |"}[fmt]
    rule = lambda h: [line(["---"] * len(h))] if fmt == "markdown" else []
    return "\n\n".join("\n".join([line(h), *rule(h), *map(line, some)]) for h, some in stanzas) + "\n"


def stanzas_in_splits(spark, tmp_path, fmt):
    """Two files that are cut within lines, headers and runs of blank lines; the later name is the larger file."""
    long = [(["a", "b"], [[str(i), f"x{i}"] for i in range(150)]), (["b", "c", "c"], [[str(i), "y", "z"] for i in range(7)]), *[([f"h{i % 3}"], [[str(i)]]) for i in range(9)]]
    short = [(["a"], [["first"], ["second"]])]
    (tmp_path / "1.txt").write_text("\n\n" + stanza_text(fmt, short))
    (tmp_path / "2.txt").write_text(stanza_text(fmt, long).replace("\n\n", "\r\n\r\n \r\n\n") + "\n\n")
    names = lambda h: [n if h.index(n) == i else f"{n}_{i - h.index(n) + 1}" for i, n in enumerate(h)]
    want = [dict(zip(names(h), r)) for h, some in short + long for r in some]
    for size in ("40", "333", "1g"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            s = read(spark, str(tmp_path), fmt)
            assert rows(s) == want
            assert size == "1g" or s.df.rdd.getNumPartitions() > 3
            assert s.columns == ["a", "b", "c", "c_2", "h0", "h1", "h2"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("fmt", ["markdown", "csvlite"])
def test_stanzas_are_split(spark, tmp_path, fmt):
    stanzas_in_splits(spark, tmp_path, fmt)


def test_pprint_is_split(spark, tmp_path):
    stanzas_in_splits(spark, tmp_path, "pprint")
