"""What programs write beside their records, and loops over nested maps."""

import glob

import pytest

import streamweave.operators  # noqa: F401
from streamweave.plans.chain import chain
from streamweave.plans.sides import taken
from streamweave.plans.stream import Stream
from streamweave.sources.writers import text_of


@pytest.fixture
def s(spark):
    rows = [(0, "x", 3, "0x10"), (1, "y", 5, "1.500"), (2, "x", 7, "+4")]
    taken()
    return Stream.of(spark.createDataFrame(rows, "k int, a string, i int, t string"), "k").select(["a", "i", "t"])


def test_print(s):
    out = chain(s, ["put", 'print $a . ":" . $i; if ($i > 4) {printn "big"; print " one"} eprint "seen"'])
    assert text_of(out, "dkvp").splitlines() == ["a=x,i=3,t=0x10", "a=y,i=5,t=1.500", "a=x,i=7,t=+4"]
    got = taken()
    assert "".join(x for to, x in got if to == "stdout") == "x:3\ny:5\nbig one\nx:7\nbig one\n" and [x for to, x in got if to == "stderr"] == ["seen\n"] * 3
    assert taken() == []


def test_print_in_a_program_that_carries_state(s):
    out = chain(s, ["put", "-q", '@sum[$a] += $i; print "so far " . @sum[$a]; end {dump; print > stderr, "done"; emit @sum, "a"}'])
    assert text_of(out, "dkvp").splitlines() == ["a=x,sum=10", "a=y,sum=5"]
    got = taken()
    assert "".join(x for to, x in got if to == "stdout") == 'so far 3\nso far 5\nso far 10\n{\n  "sum": {\n    "x": 10,\n    "y": 5\n  }\n}\n'
    assert ("stderr", "done\n") in got


def _files(path):
    return {f.split("to=")[1].split("/")[0]: open(f).read() for f in glob.glob(f"{path}/to=*/part-*")}


def test_redirects_to_named_outputs(s, tmp_path):
    chain(s, ["put", "-q", f'print > "{tmp_path}/all", $i; tee > "{tmp_path}/records", $*; emit > "{tmp_path}/maps", {{"a": $a, "j": $i * 2}}'])
    read = lambda name: "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*")))
    assert read("all") == "3\n5\n7\n"
    assert read("records").splitlines()[1] == '{"a": "y", "i": 5, "t": 1.500}'
    assert read("maps").splitlines() == ['{"a": "x", "j": 6}', '{"a": "y", "j": 10}', '{"a": "x", "j": 14}']


def test_redirects_to_outputs_that_records_name(s, tmp_path):
    chain(s, ["put", "-q", "--folder", str(tmp_path / "r"), 'print > $a, $i'])
    assert _files(tmp_path / "r") == {"x": "3\n7\n", "y": "5\n"}
    chain(s, ["put", "-q", "--folder", str(tmp_path / "q"), '@n += 1; print > $a, @n'])
    assert _files(tmp_path / "q") == {"x": "1\n3\n", "y": "2\n"}


def test_loops_over_maps_within_maps(s):
    program = 'm = {"p": {"q": $i, "r": 2}, "s": {"t": 3}}; $z = ""; for ((k1, k2), v in m) {$z = $z . k1 . k2 . v . ";"}'
    assert text_of(chain(s, ["put", program, "then", "cut", "-f", "z"]), "dkvp").splitlines()[0] == "z=pq3;pr2;st3;"
    sums = '@c[$a][$i] = $i * 2; end {for ((x, y), v in @c) {emit {"x": x, "y": y, "v": v}}}'
    assert text_of(chain(s, ["put", "-q", sums]), "dkvp").splitlines() == ["x=x,y=3,v=6", "x=x,y=7,v=14", "x=y,y=5,v=10"]


def test_fields_that_a_program_leaves_alone_stay_as_written(s):
    out = chain(s, ["put", "@n += 1; $n = @n; $u = $t + 1"])
    assert text_of(out, "dkvp").splitlines() == ["a=x,i=3,t=0x10,n=1,u=17", "a=y,i=5,t=1.500,n=2,u=2.5", "a=x,i=7,t=+4,n=3,u=5"]


def test_no_pipes(s):
    with pytest.raises(SyntaxError):
        chain(s, ["put", 'print | "sort", $a'])
