"""Verbs that turn fields into records and back, nest and flatten."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import HIDDEN, Stream, col, is_text, matcher
from .registry import verb


def _common(s: Stream, names) -> str:
    """One type for values that come to stand in one column."""
    kinds = {s.dtype(c).simpleString() for c in names}
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {"tinyint", "smallint", "int", "bigint"}:
        return "bigint"
    return "double" if kinds <= {"tinyint", "smallint", "int", "bigint", "float", "double"} else "string"


@verb("reshape", "-i=i:list -r=r:list -o=o:list -s=s_:list")
def reshape(s: Stream, i=None, r=None, o=None, s_=None, keys=None) -> Stream:
    """Wide to long (i or r, and o: key and value name), or long to wide (s: key and value field).

    Wide to long: an absent field gives no record. Long to wide: records group by all other fields; of repeated keys the last
    value counts, missing cells are absent. ``keys`` lists the new fields, and spares the pass that finds them.
    """
    if s_ is None:
        ms = [matcher(p) for p in r or ()]
        names = [c for c in s.columns if c in (i or ()) or any(m.search(c) for m in ms)]
        if not names:
            return s
        kind = _common(s, names)
        cells = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(c).alias("k"), col(c).cast(kind).alias("v")) for k, c in enumerate(names)])
        rest = [c for c in s.columns if c not in names]
        df = s.df.select(*map(col, rest), *map(col, s.hidden), F.explode(F.filter(cells, lambda x: x["v"].isNotNull())).alias("_c"))
        df = df.select(*map(col, rest), F.col("_c.k").alias(o[0]), F.col("_c.v").alias(o[1]), *map(col, s.hidden), F.col("_c.n").alias(f"{HIDDEN}cell"))
        return Stream(df, (*s.order, (f"{HIDDEN}cell", True)))
    key, value = s_
    rest = [c for c in s.columns if c not in (key, value)]
    s = s.where(col(key).isNotNull() & col(value).isNotNull())
    order = s.first_key() if s.order else F.lit(0)
    down = not s.order or s.order[0][1]
    if keys is None:
        found = s.df.groupBy(col(key).cast("string").alias("k")).agg((F.min if down else F.max)(order).alias("o"))
        keys = [x[0] for x in found.orderBy(F.col("o").asc() if down else F.col("o").desc()).collect()]  # the new column names
    cells = {k: (F.max_by if down else F.min_by)(F.when(col(key).cast("string") == k, col(value)), F.when(col(key).cast("string") == k, order)) for k in keys}
    from .aggregates import grouped

    return grouped(s, rest, cells)


@verb("nest", "--explode=how:is-explode --implode=how:is-implode --values=what:is-values --pairs=what:is-pairs --across-records=across:is-records --across-fields=across:is-fields -f=f:str -r=r:str --nested-fs=fs:str --nested-ps=ps:str --evar=evar:str --ivar=ivar:str")
def nest(s: Stream, how=None, what="values", across="records", f=None, r=None, fs=";", ps=":", evar=None, ivar=None, width=None) -> Stream:
    """Explode a field's values or pairs across records or fields, or implode values across records.

    Across fields the greatest number of values must be known: ``width``, or a pass that finds it; pairs likewise their names.
    """
    names = {"semicolon": ";", "comma": ",", "pipe": "|", "colon": ":", "space": " ", "tab": "\t"}
    if evar:
        how, fs = "explode", evar
    if ivar:
        how, fs = "implode", ivar
    fs, ps = names.get(fs, fs), names.get(ps, ps)
    if r and not f:
        m = matcher(r)
        f = next((c for c in s.columns if m.search(c)), None)
    if f not in s.columns:
        return s
    text = col(f).cast("string")
    parts = F.split(text, re.escape(fs), -1)
    at = s.columns.index(f)
    before, after = s.columns[:at], s.columns[at + 1 :]
    if how == "implode":
        rest = before + after
        order = s.first_key() if s.order and s.uniform else F.lit(0)
        down = not s.order or s.order[0][1]
        lacking = s.where(col(f).isNull())
        from .aggregates import grouped

        seen = F.collect_list(F.struct(order.alias("o"), text.alias("v")))
        joined = F.array_join(F.transform(F.array_sort(seen) if down else F.reverse(F.array_sort(seen)), lambda x: x["v"]), fs)
        out = grouped(s.where(col(f).isNotNull()), rest, {f: joined}).select(before + [f] + after)
        if not s.order or not s.uniform:
            return out
        # those that lack the field come first, in their order
        own = Stream(lacking.df.select(*map(col, lacking.columns), order.alias(f"{HIDDEN}first")))
        df = own.df.withColumn(f"{HIDDEN}late", F.lit(0)).unionByName(out.df.withColumn(f"{HIDDEN}late", F.lit(1)))
        return Stream(df, ((f"{HIDDEN}late", True), (f"{HIDDEN}first", down)))
    n = f"{HIDDEN}part"
    if across == "records":
        # an absent field leaves its record as it is
        df = s.df.select("*", F.posexplode_outer(parts).alias(n, "_v"))
        if what == "values":
            df = df.select(*map(col, before), F.col("_v").alias(f), *map(col, after), *map(col, s.hidden), col(n))
            return Stream(df, (*s.order, (n, True)))
        at_ = F.instr("_v", ps)
        df = df.withColumn("_k", F.when(at_ > 0, F.substring_index("_v", ps, 1)).otherwise(F.lit(f))).withColumn("_w", F.when(at_ > 0, F.expr(f"substring(_v, instr(_v, '{ps}') + {len(ps)})")).otherwise(F.col("_v")))
        keys = width or [x[0] for x in df.where("_k IS NOT NULL").groupBy("_k").agg(F.min(n).alias("o")).orderBy("o", "_k").collect()]
        df = df.select(*map(col, before), *[F.when(F.col("_k") == k, F.col("_w")).alias(k) for k in keys], *map(col, after), *map(col, s.hidden), col(n))
        return Stream(df, (*s.order, (n, True)))
    if what == "values":
        width = width or s.df.agg(F.max(F.size(parts))).first()[0] or 0
        return s.select(before + [F.try_element_at(parts, F.lit(k + 1)).alias(f"{f}_{k + 1}") for k in range(width)] + after)
    pairs = F.map_from_entries(F.transform(parts, lambda v: F.struct(F.when(F.instr(v, ps) > 0, F.substring_index(v, ps, 1)).otherwise(F.lit(f)).alias("k"), F.when(F.instr(v, ps) > 0, F.array_join(F.slice(F.split(v, re.escape(ps), -1), 2, F.size(F.split(v, re.escape(ps), -1))), ps)).otherwise(v).alias("v"))))
    keys = width or sorted(x[0] for x in s.df.select(F.explode(F.map_keys(pairs)).alias("k")).distinct().collect())
    return s.select(before + [F.try_element_at(pairs, F.lit(k)).alias(k) for k in keys] + after)


@verb("altkv", positional="")
def altkv(s: Stream) -> Stream:
    """Values pair up as key and value, by position; an odd one stands under its pair's number. The result is one map field ``kv``."""
    cols = [col(c).cast("string") for c in s.columns]
    pairs = [F.struct(k.alias("k"), v.alias("v")) for k, v in zip(cols[::2], cols[1::2])]
    if len(cols) % 2:
        pairs.append(F.struct(F.lit(str(len(cols) // 2 + 1)).alias("k"), cols[-1].alias("v")))
    last = F.aggregate(F.array(*pairs), F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return s.select([last.alias("kv")])


@verb("repeat", "-n=n:int -f=f:str")
def repeat(s: Stream, n=None, f=None) -> Stream:
    """Each record n times, or as often as its field says; none where that is not a positive number."""
    times = F.lit(n) if f is None else F.coalesce(_long(s, f), F.lit(0))
    k = f"{HIDDEN}copy"
    df = s.df.where(times >= 1).withColumn(k, F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint"))))
    return Stream(df, (*s.order, (k, True)))


def _long(s: Stream, f: str) -> Column:
    from ..plans.stream import number

    return number(s, f).cast("bigint")


def _leaves(c: Column, t: T.DataType, name: str, sep: str, sizes: dict):
    """Column and name of each leaf below a nested field."""
    if isinstance(t, T.StructType):
        if not t.fields:
            yield F.when(c.isNotNull(), F.lit("{}")), name
        for x in t.fields:
            yield from _leaves(c.getField(x.name), x.dataType, f"{name}{sep}{x.name}", sep, sizes)
    elif isinstance(t, T.ArrayType):
        n = sizes.get(name, 0)
        if not n:
            yield F.when(c.isNotNull(), F.lit("{}")), name
        for i in range(n):
            yield from _leaves(F.try_element_at(c, F.lit(i + 1)), t.elementType, f"{name}{sep}{i + 1}", sep, sizes)
    elif isinstance(t, T.MapType):
        for k in sizes.get(name, ()):
            yield from _leaves(F.try_element_at(c, F.lit(k)), t.valueType, f"{name}{sep}{k}", sep, sizes)
    else:
        yield c, name


def _sizes(s: Stream, c: Column, t: T.DataType, name: str, sep: str, out: list):
    """What only the data can tell: lengths of arrays, keys of maps. One aggregate each, all in one pass."""
    if isinstance(t, T.StructType):
        for x in t.fields:
            _sizes(s, c.getField(x.name), x.dataType, f"{name}{sep}{x.name}", sep, out)
    elif isinstance(t, T.ArrayType):
        out.append((name, F.max(F.size(c))))
    elif isinstance(t, T.MapType):
        out.append((name, F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(c)))))))


@verb("flatten", "-f=f:list -s=sep:str")
def flatten(s: Stream, f=None, sep=".") -> Stream:
    """Maps and arrays become fields ``a.b.c``; elements of arrays count from 1."""
    nested = [c for c in s.columns if (not f or c in f) and isinstance(s.dtype(c), (T.StructType, T.ArrayType, T.MapType))]
    if not nested:
        return s
    asked: list = []
    for c in nested:
        _sizes(s, col(c), s.dtype(c), c, sep, asked)
    sizes = {}
    if asked:
        got = s.df.agg(*[a.alias(str(i)) for i, (_, a) in enumerate(asked)]).first()
        sizes = {n: got[i] or 0 if not isinstance(got[i], list) else got[i] for i, (n, _) in enumerate(asked)}
    out = []
    for c in s.columns:
        out += [x.alias(n) for x, n in _leaves(col(c), s.dtype(c), c, sep, sizes)] if c in nested else [c]
    return s.select(out)


@verb("unflatten", "-f=f:list -s=sep:str")
def unflatten(s: Stream, f=None, sep=".") -> Stream:
    """Fields ``a.b.c`` become nested; pieces 1, 2, ... in a row become arrays. Names with an empty piece stay."""
    tree: dict = {}
    for c in s.columns:
        pieces = c.split(sep)
        if len(pieces) < 2 or "" in pieces or (f and pieces[0] not in f):
            tree[c] = col(c)
            continue
        node = tree
        for p in pieces[:-1]:
            nxt = node.setdefault(p, {})
            if not isinstance(nxt, dict):
                nxt = node[p] = {}
            node = nxt
        node[pieces[-1]] = col(c)

    def build(node):
        if not isinstance(node, dict):
            return node
        keys = list(node)
        if keys == [str(i + 1) for i in range(len(keys))]:
            return F.array(*[build(v) for v in node.values()])
        return F.struct(*[build(v).alias(k) for k, v in node.items()])

    return s.select([build(v).alias(k) for k, v in tree.items()])


@verb("json-parse", "-f=f:list -k=keep:true -a=arrays:true")
def json_parse(s: Stream, f=None, keep=False, arrays=False, schema=None) -> Stream:
    """Text to its JSON value: by the given schema (a dict of field to DDL), else as a VARIANT; bad JSON is absent, or (``keep``) stays text."""
    new = {}
    for c in f or s.columns:
        if c in s.columns and is_text(s, c):
            kind = (schema or {}).get(c)
            v = F.from_json(col(c), kind) if kind else F.try_parse_json(col(c))
            new[c] = F.coalesce(F.try_parse_json(col(c)), F.to_variant_object(F.array(col(c)))) if keep and not kind else v
    return s.with_columns(new)


@verb("json-stringify", "-f=f:list --jvstack=stack:true --no-jvstack=flat:true")
def json_stringify(s: Stream, f=None, stack=False, flat=False) -> Stream:
    """Values to JSON text, on one line or (``jvstack``) several."""
    options = {"pretty": "true"} if stack else {}
    new = {}
    for c in f or s.columns:
        if c not in s.columns:
            continue
        t = s.dtype(c)
        if isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            new[c] = F.to_json(col(c), options)
        else:
            one = F.to_json(F.struct(col(c).alias("v")))
            new[c] = F.when(col(c).isNotNull(), F.regexp_extract(one, r'(?s)^\{"v":(.*)\}$', 1))
    return s.with_columns(new)


@verb("seqgen", "-f=f:str --start=start:num --stop=stop:num --step=step:num")
def seqgen(s, f="i", start=1, stop=100, step=1) -> Stream:
    """The numbers from start to stop, both included, by step; what came in is ignored. ``s``: a Stream or a SparkSession."""
    spark = s.df.sparkSession if isinstance(s, Stream) else s
    if step == 0:
        if start != stop:
            raise ValueError("seqgen: a step of 0 never ends")
        n = 1
    else:
        n = max(0, int((stop - start) / step + 1e-9) + 1) if (stop - start) / step >= 0 else 0
    ids = spark.range(n)
    value = F.lit(start) + F.col("id") * F.lit(step)
    return Stream(ids.select(value.alias(f), F.col("id").alias(f"{HIDDEN}id")), ((f"{HIDDEN}id", True),))

