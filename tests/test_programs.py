"""The expression language over small streams."""

import math

import pytest

import streamweave.operators  # noqa: F401
from streamweave.plans.chain import chain
from streamweave.plans.dsl import Parser
from streamweave.plans.stream import Stream
from streamweave.sources.writers import text_of

ROWS = [("pan", "pan", 1, "0.5", "3"), ("eks", "pan", 2, "0.25", "x"), ("wye", "wye", 3, None, ""), ("eks", "wye", 4, "2", "0xff")]


@pytest.fixture(scope="module")
def s(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, a string, b string, i int, x string, y string")
    return Stream.of(df, "k").select(["a", "b", "i", "x", "y"])


def put(s, text, *flags):
    return text_of(chain(s, ["put", *flags, text]), "dkvp").splitlines()


def cells(s, expressions):
    """What each expression gives for the first record."""
    program = "; ".join(f"$r{i} = {e}" for i, e in enumerate(expressions))
    row = chain(s, ["put", program]).sorted().first().asDict()
    return [row.get(f"r{i}") for i in range(len(expressions))]


EXPRESSIONS = {
    "1 + 2 * 3": 7, "(1 + 2) * 3": 9, "2 ** 3 ** 2": 512.0, "-2 ** 2": -4, "7 // 2": 3, "-7 // 2": -4, "7 % 5": 2, "-7 % 5": 3, "7 % -5": -3, "6 / 4": 1.5, "6 / 2": 3.0, "1 / 0": math.inf, "-1 / 0": -math.inf,
    "0xff + 1": 256, "0b101": 5, "0o17": 15, "1.5e3": 1500.0, "5 .+ 3": 8, "9223372036854775807 .+ 1": -9223372036854775808, "3 .* 4": 12, "5 .- 7": -2, "6 & 3": 2, "6 | 3": 7, "6 ^ 3": 5, "~5": -6, "1 << 4": 16, "-8 >> 1": -4,
    "1 < 2": True, '"abc" < "abd"': True, '10 < 9': False, '"10" . "" < "9"': True, "1 <=> 2": -1, "true && false": False, "true || false": True, "true ^^ true": False, "!true": False, "1 < 2 ? \"y\" : \"n\"": "y", "$nosuch ?? 5": 5, '"" ??? 6': "6",
    "$nosuch + 1": 1, "$nosuch . \"s\"": "s", "1 . 2": "12", "$x + 1": 1.5, "$x . \"s\"": "0.5s", "$i + 1": 2, "$i . $a": "1pan", "M_PI > 3": True, "NR": 1,
    'strlen("héllo")': 5, 'toupper("ab")': "AB", 'capitalize("ab")': "Ab", 'lstrip("  a ")': "a ", 'strip("  a ")': "a", 'clean_whitespace("  a   b ")': "a b", 'truncate("héllo", 2)': "hé", 'leftpad(5, 10, "0")': "0000000005", 'leftpad("x", 4, "ab")': "abx",
    'rightpad(5, 3, "*")': "5**", 'format("{}:{}", 3, "x")': "3:x", 'format("{}:{}", 3)': "3:", 'unformat("<>;<>", "3;4.5")[2]': "4.5", 'gssub("a.b.c", ".", "")': "abc", 'ssub("a.b.c", ".", "")': "ab.c", 'sub("abab", "b", "X")': "aXab", 'gsub("abab", "b", "X")': "aXaX",
    'sub("abc", "(b)", "<\\1\\1>")': "a<bb>c", 'gsub("banana", "a(.)", "<\\1>")': "b<n><n>a", 'sub("abc", "^a", "X")': "Xbc", 'regextract("abc123", "[0-9]+")': "123", 'regextract("abc", "[0-9]+")': None, 'regextract_or_else("abc", "[0-9]+", "no")': "no",
    '"abc" =~ "a(b)c"': True, '"abc" !=~ "x"': True, '"ABC" =~ "a(b)c"i': True, 'strmatchx("abc", "(b)")["capture_1"]': "b", 'substr("hello", 1, 3)': "ell", 'substr1("hello", 2, 4)': "ell", 'substr1("hello", -4, -2)': "ell", '"hello"[2:3]': "el", 'index("abcde", "cd")': 3,
    'contains("abc", "b")': True, 'md5("a")': "0cc175b9c0f1b6a831c399e269772661", 'sha1("a")': "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8", 'hex_encode("abc")': "616263", 'base64_encode("abc")': "YWJj", 'string(hex_decode("616263"))': "abc",
    "abs(-3)": 3, "ceiling(1.2)": 2.0, "floor(-1.2)": -2.0, "round(-2.5)": -3.0, "roundm(7.3, 2)": 8.0, "sgn(-4)": -1, "exp(0)": 1.0, "max(1, 2.5)": 2.5, "min(3, 2)": 2, 'max(1, "a")': "a", 'min(1, "a")': "1", "bitcount(255)": 8, "madd(5, 3, 7)": 1, "mexp(2, 10, 7)": 2, "msub(5, 6, 7)": 6, "mmul(3, 4, 5)": 2,
    "erf(0)": 0.0, "qnorm(0)": 0.5, "invqnorm(0.5)": 0.0, "logifit(2, 3, 4)": 1 / (1 + math.exp(-10)), "fmtnum(3.1, \"%d\")": "3", 'fmtnum(17, "%08x")': "00000011", 'fmtnum(3, "%.2lf")': "3.00", 'fmtifnum("ab", "%.2f")': "ab", "hexfmt(255)": "0xff", 'int("0xff")': 255, "int(3.7)": 3, "float(3)": 3.0,
    "sec2gmt(0)": "1970-01-01T00:00:00Z", "sec2gmt(1.25, 3)": "1970-01-01T00:00:01.250Z", 'sec2gmt("x")': "x", "sec2gmtdate(86400)": "1970-01-02", 'gmt2sec("1970-01-02T00:00:00Z")': 86400, 'gmt2sec("1970-01-02")': 86400, 'strftime(0, "%Y-%m-%dT%H:%M:%3SZ")': "1970-01-01T00:00:00.000Z",
    'strptime("2023-01-01T00:00:00Z", "%Y-%m-%dT%H:%M:%SZ")': 1672531200.0, 'strptime("bad", "%Y")': None, 'sec2localtime(0, "Asia/Istanbul")': "1970-01-01 02:00:00", 'strftime_local(0, "%H", "Asia/Istanbul")': "02", "sec2dhms(500000)": "5d18h53m20s", "fsec2dhms(5000.25)": "1h23m20.250000s", "fsec2hms(5000.25)": "01:23:20.250000",
    "sec2hms(5000)": "01:23:20", 'dhms2sec("1d2h3m4s")': 93784, 'dhms2fsec("1d2h3m4.5s")': 93784.5, 'hms2sec("01:23:20")': 5000, 'hms2sec("-00:00:20")': -20, 'hms2fsec("01:23:20.25")': 5000.25, 'datediff("2020-01-31", "2020-03-01", "m")': 1, "nsec2gmt(1500000000, 6)": "1970-01-01T00:00:01.500000Z",
    "typeof(1)": "int", "typeof(1.5)": "float", 'typeof("")': "empty", 'typeof("a")': "string", "typeof($x)": "float", "typeof($nosuch)": "absent", "typeof([1])": "array", "typeof({})": "map", "typeof(true)": "boolean", "asserting_int(3)": 3, "is_empty(\"\")": True, "is_not_empty($a)": True, "is_absent($nosuch)": True,
    'splitax("a,b,c", ",")[2]': "b", 'joink({"a": 1, "b": 2}, ",")': "a,b", 'joinv({"a": 1, "b": 2}, ",")': "1,2", 'joinkv({"a": 1, "b": 2}, "=", ",")': "a=1,b=2", 'splitkv("a=1,b=2", "=", ",")["b"]': "2", 'splitnv("x,y", ",")["2"]': "y", "length([1, 2, 3])": 3, "length($nosuch)": 0, "depth({\"a\": 1})": 1,
    "append([1, 2], 3)[3]": 3, "concat([1], [2, 3])[2]": 2, 'haskey([1, 2], -2)': True, 'haskey({"a": 1}, "b")': False, 'hasvalue([1, 2], 2)': True, 'mapsum({"a": 1}, {"b": 2})["b"]': 2, 'joink(mapdiff({"a": 1, "b": 2}, {"a": 3}), ",")': "b", 'joink(mapexcept({"a": 1, "b": 2}, ["a"]), ",")': "b", 'joink(mapselect({"a": 1, "b": 2}, "a"), ",")': "a",
    'get_keys({"a": 1})[1]': "a", 'get_values({"a": 7})[1]': 7, "[1, 2, 3][-1]": 3, "[1, 2, 3][2:3][1]": 2, 'json_stringify({"a": 1})': '{"a":1}', "leafcount([1, 2])": 2,
    "sum([1, 2, 3])": 6, "sum2([1, 2, 3])": 14.0, "mean([1, 2, 3])": 2.0, "variance([1, 2, 3, 4])": 5 / 3, "median([3, 1, 2])": 2, "percentile([1, 2, 3, 4, 5], 25)": 2, 'percentiles([1, 2, 3, 4, 5], [25, 75])["75"]': 4.0, 'mode(["a", "b", "a"])': "a", "minlen([\"a\", \"bcd\"])": 1, "distinct_count([1, 1, 2])": 2, "sort_collection([3, 1, 2])[1]": 1.0,
    "apply([1, 2], func(e) { return e * 10 })[2]": 20, "select([1, 2, 3], func(e) { return e > 1 })[1]": 2, "reduce([1, 2, 3], func(acc, e) { return acc + e })": 6, "fold([1, 2, 3], func(acc, e) { return acc + e }, 10)": 16, "any([1, 2], func(e) { return e > 1 })": True, "every([1, 2], func(e) { return e > 1 })": False,
    "sort([5, 2, 3])[1]": 2, 'sort([5, 2, 3], "nr")[1]': 5, "sort([5, 2, 3], func(a, b) { return b <=> a })[1]": 5, 'sort(["a5", "a10"], "t")[1]': "a5", "sparkline([1, 2, 8])": "▁▂█",
}


def test_expressions(s):
    names = list(EXPRESSIONS)
    bad = []
    for at in range(0, len(names), 40):
        some = names[at : at + 40]
        for e, got in zip(some, cells(s, some)):
            want = EXPRESSIONS[e]
            same = got == want or isinstance(want, float) and got is not None and math.isclose(float(got), want, rel_tol=1e-9, abs_tol=1e-12)
            if not same or isinstance(want, bool) != isinstance(got, bool):
                bad.append((e, got, want))
    assert not bad, bad


def test_precedence():
    tree = lambda text: Parser(text).expr()
    assert tree("1 . 2 * 3") == ("call", "*", [("call", ".", [("lit", 1), ("lit", 2)]), ("lit", 3)])
    assert tree("$x ?? 1 + 2") == ("call", "+", [("call", "??", [("field", "x"), ("lit", 1)]), ("lit", 2)])
    assert tree("a || b && c") == ("call", "||", [("name", "a"), ("call", "&&", [("name", "b"), ("name", "c")])])
    assert tree("2 ** -1") == ("call", "**", [("lit", 2), ("call", "-", [("lit", 1)])])


PROGRAMS = {
    "$z = $i > 2": ["z=false", "z=false", "z=true", "z=true"],
    'if ($i > 3) {$z = "b"} elif ($i == 3) {$z = "t"} else {$z = "s"}': ["z=s", "z=s", "z=t", "z=b"],
    '$i > 2 {$z = "big"}': ["", "", "z=big", "z=big"],
    '$a =~ "^(.)(.)" {$z = "\\2:\\1"}': ["z=a:p", "z=k:e", "z=y:w", "z=k:e"],
    "func f(str s, num n): str { if (n > 2) { return s . n } return s } $z = f($a, $i)": ["z=pan", "z=eks", "z=wye3", "z=eks4"],
    "func f(n) { var r = 1; if (n > 2) { r = 10 } else { r = 20 } return r + n } $z = f($i)": ["z=21", "z=22", "z=13", "z=14"],
    "subr p(str t) { $z = t . \"!\" } call p($a)": ["z=pan!", "z=eks!", "z=wye!", "z=eks!"],
    "var t = $i * 2; t += 1; $z = t": ["z=3", "z=5", "z=7", "z=9"],
    "$z = $x": ["z=0.5", "z=0.25", "", "z=2"],
    "$z = 5; unset $z; $i >= 3 { $z = 1 }": ["", "", "z=1", "z=1"],
    'filter $i % 2 == 0; $z = $i': ["z=2", "z=4"],
    "for (k, v in $*) { if (k == \"i\") { $z = k . v } }": ["z=i1", "z=i2", "z=i3", "z=i4"],
    "for (int j = 0; j < 3; j += 1) { $z = j . $i }": ["z=21", "z=22", "z=23", "z=24"],
    "for (e in [1, 2, 3]) { $z = e + $i }": ["z=4", "z=5", "z=6", "z=7"],
    '$* = {"z": $i}': ["z=1", "z=2", "z=3", "z=4"],
    '$* = mapsum({"z": $i}, mapselect($*, "q"))': ["z=1", "z=2", "z=3", "z=4"],
    '$[[1]] = "z"': ["z=pan", "z=eks", "z=wye", "z=eks"],
    '$[[[1]]] = "q"; $z = $[[[1]]] . $[[2]]': ["z=qb", "z=qb", "z=qb", "z=qb"],
    '${new field} = 1; $z = ${new field} + 1': ["z=2", "z=2", "z=2", "z=2"],
    'm = {"p": {"q": 5}}; m["p"]["r"] = $i; $z = m["p"]["q"] + m["p"]["r"]': ["z=6", "z=7", "z=8", "z=9"],
    "@k = 3; $z = @k + $i": ["z=4", "z=5", "z=6", "z=7"],
    "@k = $i * 2; $z = @k + 1": ["z=3", "z=5", "z=7", "z=9"],
    "$z = NF": ["z=5", "z=5", "z=4", "z=5"],
    "begin { @k = 10 } $z = @k + $i": ["z=11", "z=12", "z=13", "z=14"],
    "$y += 1; $z = $y": ["z=4", "z=1", "z=1", "z=256"],
    "$z = is_present($x) && $x > 0.3": ["z=true", "z=false", "z=false", "z=true"],
    "# a comment\n$z = 1 # another": ["z=1"] * 4,
}


@pytest.mark.parametrize("text", list(PROGRAMS))
def test_program(s, text):
    got = text_of(chain(s, ["put", text, "then", "cut", "-f", "z"]), "dkvp").splitlines()
    assert got == PROGRAMS[text]


EMITS = {
    "@sum[$a][$b] += $i; end { emit @sum, \"a\", \"b\" }": ["a=pan,b=pan,sum=1", "a=eks,b=pan,sum=2", "a=wye,b=wye,sum=3", "a=eks,b=wye,sum=4"],
    "@sum[$a][$b] += $i; @n[$a][$b] += 1; end { emit (@sum, @n), \"a\", \"b\" }": ["a=pan,b=pan,sum=1,n=1", "a=eks,b=pan,sum=2,n=1", "a=wye,b=wye,sum=3,n=1", "a=eks,b=wye,sum=4,n=1"],
    "@sum[$a][$b] += $i; end { emit @sum, \"a\" }": ["a=pan,pan=1", "a=eks,pan=2,wye=4", "a=wye,wye=3"],
    "@sum[$a][$b] += $i; end { emit @sum }": ["pan=1", "pan=2,wye=4", "wye=3"],
    "@sum[$a][$b] += $i; end { emitp @sum, \"a\" }": ["a=pan,sum.pan=1", "a=eks,sum.pan=2,sum.wye=4", "a=wye,sum.wye=3"],
    "@sum[$a] += $i; end { emitp @sum }": ["sum.pan=1,sum.eks=6,sum.wye=3"],
    "@c += 1; @m = max(@m, $i); end { emitf @c, @m }": ["c=4,m=4"],
    "begin { @c = 10 } @c += $i; end { emit @c }": ["c=20"],
    "@last[$a] = $i; end { emit @last, \"a\" }": ["a=pan,last=1", "a=eks,last=4", "a=wye,last=3"],
    "$i > 1 { @big[$a] += 1 } end { emit @big, \"a\" }": ["a=eks,big=2", "a=wye,big=1"],
    "@s += $i; @n += 1; end { emit {\"total\": @s, \"rows\": @n} }": ["total=10,rows=4"],
    'emit {"a": $a, "t": $i * 2}': ["a=pan,t=2", "a=eks,t=4", "a=wye,t=6", "a=eks,t=8"],
    'emit mapselect($*, "i"); $i == 2 { emit {"extra": $a} }': ["i=1", "i=2", "extra=eks", "i=3", "i=4"],
}


@pytest.mark.parametrize("text", list(EMITS))
def test_emit(s, text):
    assert put(s, text, "-q") == EMITS[text]


def test_emit_beside_the_records(s):
    out = text_of(chain(s, ["put", "@c += 1; end { emit @c }", "then", "cut", "-f", "i,c"]), "dkvp").splitlines()
    assert out == ["i=1", "i=2", "i=3", "i=4", "c=4"]


def test_filters(s):
    ids = lambda *words: [r.i for r in chain(s, ["filter", *words]).sorted().collect()]
    assert ids("$i > 2") == [3, 4] and ids("-x", "$i > 2") == [1, 2] and ids('$a == "eks" && $x < 1') == [2]
    assert ids("$x > 0.3") == [1, 4]  # an absent value drops the record
    assert ids("true; false") == []
    assert ids("-s", "k=3", "$i == @k") == [3]
    assert ids("-q", "true") == []


def test_programs_that_cannot_be(s):
    for bad in ("$x = ", "$x = 1 $y = 2", "frob($x)", "strlen()"):
        with pytest.raises((SyntaxError, ValueError)):
            chain(s, ["put", bad])


def test_the_table_holds_every_function():
    from streamweave.functions.scalars import FUNCTIONS

    wanted = """+ - * / // ** pow .+ .- .* ./ % ~ & | ^ << >> >>> bitcount madd msub mmul mexp ! == != > >= <=> < <= =~ !=~ && || ^^ ?? ??? ?: strmatch strmatchx . base64_decode base64_encode hex_decode hex_encode capitalize
    clean_whitespace collapse_whitespace lstrip regextract regextract_or_else rstrip strip strlen ssub gssub sub gsub substr0 substr1 substr index contains tolower toupper truncate leftpad rightpad format unformat unformatx
    latin1_to_utf8 utf8_to_latin1 md5 sha1 sha256 sha512 abs acos acosh asin asinh atan atan2 atanh cbrt ceil cos cosh erf erfc exp expm1 floor invqnorm log log10 log1p logifit max min qnorm round sgn sin sinh sqrt tan tanh roundm
    urand urandint urandrange urand32 urandelement count distinct_count null_count sparkline mode antimode sum sum2 sum3 sum4 mean meaneb variance stddev skewness kurtosis minlen maxlen median percentile percentiles sort_collection
    datediff gmt2sec gmt2nsec localtime2sec localtime2nsec sec2gmt nsec2gmt sec2localtime nsec2localtime sec2gmtdate nsec2gmtdate sec2localdate nsec2localdate localtime2gmt gmt2localtime strftime strfntime strftime_local
    strfntime_local strptime strpntime strptime_local strpntime_local dhms2fsec dhms2sec fsec2dhms fsec2hms hms2fsec hms2sec sec2dhms sec2hms systime sysntime systimeint uptime upntime typeof boolean bytes float fmtnum fmtifnum
    hexfmt int joink joinv joinkv splita splitax splitkv splitkvx splitnv splitnvx string append arrayify concat depth flatten unflatten get_keys get_values haskey hasvalue json_parse json_stringify leafcount length mapdiff mapexcept
    mapselect mapsum hostname os system exec stat version next""".split()
    missing = [w for w in wanted if w not in FUNCTIONS]
    assert not missing, missing


SEQUENTIAL = {
    "$z = @k; @k = $i": ["", "z=1", "z=2", "z=3"],
    "func f(n) { if (n <= 1) { return 1 } return n * f(n - 1) } $z = f($i)": ["z=1", "z=2", "z=6", "z=24"],
    "var n = $i; var c = 0; while (n != 1) { if (n % 2 == 0) { n = n // 2 } else { n = 3 * n + 1 } c += 1 } $z = c": ["z=0", "z=1", "z=7", "z=2"],
    "@seen[$a] = 1; $z = length(@seen)": ["z=1", "z=2", "z=3", "z=3"],
    "@s += $i; $z = @s": ["z=1", "z=3", "z=6", "z=10"],
    "m = {}; for (k, v in $*) { m[k . v] = 1 } $z = length(m)": ["z=5", "z=5", "z=4", "z=5"],
    'for (i = 0; i < $i; i += 1) { if (i == 2) { break } $z = i }': ["z=0", "z=1", "z=1", "z=1"],
    "$[$a] = 1; $z = haskey($*, \"eks\")": ["z=false", "z=true", "z=false", "z=true"],
}


@pytest.mark.parametrize("text", list(SEQUENTIAL))
def test_programs_that_take_one_record_after_the_other(s, text):
    got = text_of(chain(s, ["put", text, "then", "cut", "-f", "z"]), "dkvp").splitlines()
    assert got == SEQUENTIAL[text]


def test_retained_records_and_computed_ends(s):
    out = put(s, "@r[NR] = $*; end { for (k, v in @r) { emit mapsum({\"k\": k}, mapselect(v, \"i\")) } }", "-q")
    assert out == ["k=1,i=1", "k=2,i=2", "k=3,i=3", "k=4,i=4"]
    out = put(s, "@s += $i; @n += 1; end { @mean = @s / @n; emit @mean }", "-q")
    assert out == ["mean=2.5"]
    out = put(s, "@c[$a] += 1; end { for (k, v in @c) { if (v > 1) { emit {\"x\": k, \"n\": v} } } }", "-q")
    assert out == ["x=eks,n=2"]


def test_times_are_short_to_work_out(spark):
    """A time read from text and shown in a zone: each step looks at the text a few times, not once for every part of every part."""
    from pyspark.sql import functions as F

    from streamweave.functions.scalars import gmt2sec, strftime

    texts = {"2020-1-2": 1577923200, "2020-01-02 3:04z": 1577934240, "2020-01-02T03:04:05Z\n": 1577934245, "1-1-1T1": -62135593200, "2020-02-30": None, "2020-01-02T24:00:00Z": None, "2020-01-02 03:": None, "-5-1-1": None, "2020-01-02ZZ": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", gmt2sec(F.col("t"))).collect()} == texts
    shown = df.select(strftime(gmt2sec(F.col("t")), "it's %H%H o'clock, %d%e %b%m %Y-%m-%d", "Asia/Tokyo").alias("s"))
    assert [r[0] for r in shown.collect()][:3] == ["it's 0909 o'clock, 022 Jan01 2020-01-02", "it's 1212 o'clock, 022 Jan01 2020-01-02", "it's 1212 o'clock, 022 Jan01 2020-01-02"]
    plain = df.select(strftime(gmt2sec(F.col("t")), "%Y-%m-%d %H:%M:%S", "Asia/Tokyo").alias("s"))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("t#") < 12
