"""Queries of the function table: expressions over the shared tables, each beside the SQL that gives the same value."""

from __future__ import annotations

from .plans.chain import chain
from .queries import KEYS, QUERIES, SQL, shown, table


def calculated(name: str, source: str, items: list[tuple[str, str]], before: str = "") -> None:
    """Over every record of a table, fields f1, f2, ... from (expression, SQL). ``before``: statements that come first."""
    keys = KEYS[source]
    fields = [f"f{i + 1}" for i in range(len(items))]
    program = before + " ".join(f"${f} = {e};" for f, (e, _) in zip(fields, items))

    def run(spark, sf_dir):
        return shown(chain(table(spark, sf_dir, source), ["put", program, "then", "cut", "-o", "-f", ",".join([*keys, *fields])]))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{q} AS {f}' for f, (_, q) in zip(fields, items))} FROM {source}"


def r6(sql: str) -> str:
    return f"round(({sql})::DOUBLE, 6)"


calculated("functions_text_more", "part", [
    ("clean_whitespace(\"  a  b \" . $p_name)", "'a b ' || p_name"),
    ("lstrip(\"  \" . $p_brand . \" \")", "p_brand || ' '"),
    ("rstrip(\"  \" . $p_brand . \" \")", "'  ' || p_brand"),
    ("regextract($p_name, \"[a-z]+\")", "nullif(regexp_extract(p_name, '[a-z]+'), '')"),
    ("ssub($p_brand, \"#\", \"-\")", "CASE WHEN position('#' IN p_brand) > 0 THEN substr(p_brand, 1, position('#' IN p_brand) - 1) || '-' || substr(p_brand, position('#' IN p_brand) + 1) ELSE p_brand END"),
    ("substr($p_name, 1, 3)", "substr(p_name, 2, 3)"),
    ("strmatch($p_type, \"STEEL\")", "contains(p_type, 'STEEL')"),
    ("base64_decode(base64_encode($p_name))", "p_name::BLOB"),
    ("hex_decode(hex_encode($p_name))", "p_name::BLOB"),
    ("latin1_to_utf8(utf8_to_latin1($p_name))", "p_name"),
    ("format(\"{}:{}\", $p_size, $p_brand)", "p_size || ':' || p_brand"),
    ("unformat(\"<>#<>\", $p_brand)[1]", "split_part(p_brand, '#', 1)"),
    ("unformatx(\"<>#<>\", $p_brand)[2]", "split_part(p_brand, '#', 2)"),
    ("strmatchx($p_brand, \"([A-Za-z]+)#\")[\"capture_1\"]", "regexp_extract(p_brand, '([A-Za-z]+)#', 1)"),
    ("string($p_size) . \"x\"", "p_size || 'x'"),
    ("strlen(sha512($p_name))", "128"),
    ("leafcount({\"a\": $p_size, \"b\": $p_brand})", "2"),
])
calculated("functions_math_more", "orders", [
    ("acosh(1 + $o_totalprice)", r6("acosh(1 + o_totalprice)")),
    ("asinh($o_totalprice)", r6("asinh(o_totalprice)")),
    ("atanh(1 / (2 + $o_totalprice))", r6("atanh(1 / (2 + o_totalprice))")),
    ("tanh($o_totalprice / 100000)", r6("tanh(o_totalprice / 100000)")),
    ("ceil($o_totalprice)", "ceil(o_totalprice)::DOUBLE"),
    ("ceiling($o_custkey)", "o_custkey"),
    ("invqnorm(qnorm($o_custkey % 5 - 2))", r6("o_custkey % 5 - 2")),
    ("erf(0.0)", "0.0::DOUBLE"),
    ("erf($o_custkey) + erfc($o_custkey)", "1.0::DOUBLE"),
    ("mexp($o_custkey, 2, 97)", "(o_custkey * o_custkey) % 97"),
    ("$o_custkey .- 7", "o_custkey - 7"),
    ("$o_custkey ./ 7", "o_custkey // 7"),
    ("$o_custkey >>> 2", "o_custkey >> 2"),
    ("$o_custkey <= 100", "o_custkey <= 100"),
    ("9223372036854775807 .+ 1", "-9223372036854775808"),
    ("exp(0) + expm1(0)", "1.0::DOUBLE"),
    ("crc32(\"hello\")", "907060870"),
])
calculated("functions_collections_more", "lineitem", [
    (e.replace("V", "[$l_quantity, $l_linenumber, $l_tax * 100, $l_quantity]"), r6(q.replace("V", "[l_quantity, l_linenumber::DOUBLE, l_tax * 100, l_quantity]"))) for e, q in (
        ("count(V)", "4"), ("null_count(V)", "0"), ("distinct_count(V)", "len(list_distinct(V))"), ("sum(V)", "list_sum(V)"),
        ("sum2(V)", "list_sum([x * x for x in V])"), ("sum3(V)", "list_sum([x * x * x for x in V])"), ("sum4(V)", "list_sum([x * x * x * x for x in V])"), ("mean(V)", "list_avg(V)"),
        ("meaneb(V)", "sqrt(list_var_samp(V) / 4)"), ("variance(V)", "list_var_samp(V)"), ("var(V)", "list_var_samp(V)"), ("stddev(V)", "list_stddev_samp(V)"),
        ("median(V)", "list_sort(V)[3]"), ("percentile(V, 25)", "list_sort(V)[2]"), ("percentiles(V, [50, 75])[\"75\"]", "list_sort(V)[4]"), ("sort_collection(V)[1]", "list_min(V)"),
        ("kurtosis(V)", "CASE WHEN list_var_samp(V) > 1e-9 THEN list_sum([(x - list_avg(V)) ** 4 for x in V]) / 4 / (list_var_pop(V) ** 2) - 3 END"),
    )
] + [
    ("minlen([$l_returnflag, $l_shipdate, \"abc\"])", "1"), ("maxlen([$l_returnflag, \"abc\"])", "3"),
    ("mode([$l_returnflag, $l_linestatus, $l_returnflag])", "l_returnflag"), ("antimode([$l_returnflag, \"z\", $l_returnflag])", "'z'"),
    ("json_stringify(get_keys({\"a\": 1, \"b\": $l_tax}))", "'[\"a\",\"b\"]'"), ("get_values({\"a\": $l_returnflag})[1]", "l_returnflag"),
    ("hasvalue([$l_returnflag, \"x\"], \"R\")", "l_returnflag = 'R'"), ("concat([1], [$l_linenumber], [3])[2]", "l_linenumber::BIGINT"),
    ("joink(mapdiff({\"a\": 1, \"b\": 2}, {\"a\": 3}), \",\")", "'b'"), ("joink(mapselect({\"a\": 1, \"b\": 2}, \"b\"), \",\")", "'b'"),
    ("splita($l_returnflag . \";\" . $l_linestatus, \";\")[2]", "l_linestatus"), ("splitkv(\"a=\" . $l_linenumber . \";b=2\", \"=\", \";\")[\"a\"]", "l_linenumber::VARCHAR"),
    ("splitkvx(\"a=\" . $l_returnflag, \"=\", \";\")[\"a\"]", "l_returnflag"), ("splitnv($l_returnflag . \",x\", \",\")[\"1\"]", "l_returnflag"), ("splitnvx($l_returnflag . \",x\", \",\")[\"2\"]", "'x'"),
    ("reduce([$l_linenumber, 2, 3], func(acc, e) {return acc + e})", "l_linenumber + 5"), ("every([$l_linenumber, 2], func(e) {return e > 0})", "true"),
    ("apply([$l_linenumber, 2], func(e) {return e * 10})[1]", "l_linenumber * 10"), ("sort([5, $l_linenumber, 9], \"nr\")[1]", "9"),
    ("length(json_stringify(json_parse(\"{\\\"a\\\":1}\")))", "1"), ("joink(flatten(\"x\", \":\", {\"a\": 1, \"b\": 2}), \",\")", "'x:a,x:b'"), ("arrayify({\"1\": 2, \"2\": $l_linenumber})[2]", "l_linenumber::BIGINT"),
])
calculated("functions_time_zones", "orders", [
    (e.replace("@T", "$t").replace("@Z", "\"America/Sao_Paulo\""), q.replace("@T", "(epoch(o_orderdate)::BIGINT + o_orderkey % 86400)").replace("@Z", "'America/Sao_Paulo'")) for e, q in (
        ("sec2localtime(@T, @Z)", "strftime(timezone(@Z, to_timestamp(@T)), '%Y-%m-%d %H:%M:%S')"),
        ("sec2localdate(@T, @Z)", "strftime(timezone(@Z, to_timestamp(@T)), '%Y-%m-%d')"),
        ("nsec2localtime(@T * 1000000000, @Z)", "strftime(timezone(@Z, to_timestamp(@T)), '%Y-%m-%d %H:%M:%S')"),
        ("nsec2localdate(@T * 1000000000, @Z)", "strftime(timezone(@Z, to_timestamp(@T)), '%Y-%m-%d')"),
        ("nsec2gmt(@T * 1000000000)", "strftime(make_timestamp(@T * 1000000), '%Y-%m-%dT%H:%M:%SZ')"),
        ("nsec2gmtdate(@T * 1000000000)", "strftime(make_timestamp(@T * 1000000), '%Y-%m-%d')"),
        ("strftime_local(@T, \"%H:%M %z\", @Z)", "strftime(timezone(@Z, to_timestamp(@T)), '%H:%M ') || CASE WHEN epoch(timezone(@Z, to_timestamp(@T))) - @T = -7200 THEN '-0200' ELSE '-0300' END"),
        ("strftime_local(@T, \"%H %Z\", \"Asia/Tokyo\")", "strftime(timezone('Asia/Tokyo', to_timestamp(@T)), '%H JST')"),
        ("strfntime(@T * 1000000000 + 123456789, \"%S.%N\")", "strftime(make_timestamp(@T * 1000000), '%S') || '.123456789'"),
        ("strfntime_local(@T * 1000000000 + 5, \"%H:%9S\", \"Asia/Tokyo\")", "strftime(timezone('Asia/Tokyo', to_timestamp(@T)), '%H:%S') || '.000000005'"),
        ("strptime_local(sec2localtime(@T, \"Asia/Tokyo\") . \"#\", \"%Y-%m-%d %H:%M:%S#\", \"Asia/Tokyo\")", "@T"),
        ("strpntime(sec2gmt(@T), \"%Y-%m-%dT%H:%M:%S#\")", "NULL::BIGINT"),
        ("strpntime_local(sec2localtime(@T, \"Asia/Tokyo\") . \"#\", \"%Y-%m-%d %H:%M:%S#\", \"Asia/Tokyo\")", "@T * 1000000000"),
        ("gmt2sec(sec2gmt(@T))", "@T"), ("gmt2nsec(sec2gmt(@T))", "@T * 1000000000"),
        ("localtime2sec(sec2localtime(@T, \"Asia/Tokyo\"), \"Asia/Tokyo\")", "@T"), ("localtime2nsec(sec2localtime(@T, \"Asia/Tokyo\"), \"Asia/Tokyo\")", "@T * 1000000000"),
        ("localtime2gmt(sec2localtime(@T, \"Asia/Tokyo\"), \"Asia/Tokyo\")", "strftime(make_timestamp(@T * 1000000), '%Y-%m-%dT%H:%M:%SZ')"),
        ("gmt2localtime(sec2gmt(@T), \"Asia/Tokyo\")", "strftime(timezone('Asia/Tokyo', to_timestamp(@T)), '%Y-%m-%d %H:%M:%S')"),
        ("sec2dhms(@T % 86400)", "CASE WHEN @T % 86400 >= 3600 THEN printf('%dh%02dm%02ds', @T % 86400 // 3600, @T % 3600 // 60, @T % 60) WHEN @T % 86400 >= 60 THEN printf('%dm%02ds', @T % 3600 // 60, @T % 60) ELSE (@T % 60) || 's' END"),
        ("fsec2hms(@T % 86400)", "printf('%02d:%02d:%02d.000000', @T % 86400 // 3600, @T % 3600 // 60, @T % 60)"),
        ("hms2fsec(sec2hms(@T % 86400))", "(@T % 86400)::DOUBLE"), ("dhms2fsec(sec2dhms(@T % 86400))", "(@T % 86400)::DOUBLE"),
        ("fsec2dhms(@T % 60)", "(@T % 60) || '.000000s'"),
    )
], before="$t = strptime(strftime($o_orderdate, \"%Y-%m-%d\"), \"%Y-%m-%d\") + $o_orderkey % 86400; $t = int($t); ")
calculated("functions_types", "customer", [
    *[(f"is_{n}({v})", str(b).lower()) for n, v, b in (
        ("absent", "$nosuch", True), ("array", "[1]", True), ("bool", "true", True), ("boolean", "1 < 2", True), ("bytes", "bytes(\"a\")", True), ("empty_map", "{}", True), ("float", "$c_acctbal", True),
        ("int", "$c_custkey", True), ("map", "{\"a\": 1}", True), ("nonempty_map", "{\"a\": 1}", True), ("not_empty", "$c_name", True), ("not_map", "$c_name", True), ("not_array", "$c_name", True),
        ("not_null", "$c_name", True), ("null", "\"\"", True), ("numeric", "$c_name", False), ("present", "$c_name", True), ("string", "$c_name", True), ("nan", "$c_acctbal", False), ("map", "$c_name", False), ("array", "$c_name", False),
    )],
    *[(f"asserting_{n}($c_custkey)", "c_custkey") for n in ("int", "not_empty", "not_map", "not_array", "not_null", "numeric", "present")],
    ("asserting_float($c_acctbal)", r6("c_acctbal")), ("asserting_string($c_name)", "c_name"), ("asserting_bool(true)", "true"), ("asserting_boolean(false)", "false"), ("asserting_null(\"\")", "''"), ("asserting_empty(\"\")", "''"),
    ("asserting_map({\"a\": $c_custkey})[\"a\"]", "c_custkey"), ("asserting_nonempty_map({\"a\": $c_custkey})[\"a\"]", "c_custkey"), ("asserting_array([$c_custkey])[1]", "c_custkey"),
    ("length(asserting_empty_map({}))", "0"), ("typeof(asserting_absent($nosuch))", "'absent'"), ("asserting_bytes(bytes($c_name))", "c_name::BLOB"),
])
calculated("functions_random", "events", [
    ("0 <= urand() && urand() < 1", "true"), ("1 <= urandint(1, 6) && urandint(1, 6) <= 6", "true"), ("2 <= urandrange(2, 3) && urandrange(2, 3) < 3", "true"), ("0 <= urand32() && urand32() < 4294967296", "true"),
    ("strmatch(urandelement([\"a\", \"b\"]), \"^[ab]$\")", "true"), ("systime() > 1500000000", "true"), ("sysntime() > 1500000000000000000", "true"), ("systimeint() > 1500000000", "true"), ("uptime() >= 0", "true"),
    ("upntime() >= 0", "true"), ("strlen(hostname()) > 0", "true"), ("strlen(os()) > 0", "true"), ("strlen(version()) > 0", "true"), ("stat(\"/\")[\"isdir\"]", "'true'"),
])
