"""Verbs that count and aggregate."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.stream import HIDDEN, Stream, all_present, col, is_text, matcher, nonempty, number, present, q, text_double
from .registry import verb


def grouped(s: Stream, g, aggregates: dict[str, Column], keep: Column | None = None) -> Stream:
    """One record a group, in the order of first appearance: the group's fields, then the aggregates."""
    g = list(g)
    if keep is not None:
        s = s.where(keep)
    if not g:
        return Stream(s.df.agg(*[c.alias(k) for k, c in aggregates.items()]))
    keys = [col(k).alias(k) for k in g]
    first = {}
    if s.order and s.uniform:
        first = {f"{HIDDEN}first": s.least()}
    out = s.df.groupBy(*keys).agg(*[c.alias(k) for k, c in {**aggregates, **first}.items()])
    out = out.select(*map(col, [*g, *aggregates, *first]))
    if first:
        return Stream(out, ((f"{HIDDEN}first", s.order[0][1]),))
    return Stream.of(out, *g)


@verb("count", "-g=g:list -n=n:true -d=d:true -o=o:str")
def count(s: Stream, g=(), n=False, d=False, o="count") -> Stream:
    """Records, by group; with ``n`` the number of groups; with ``d`` the groups only."""
    s = s.where(all_present(s, g))
    if not g:
        return Stream(s.df.agg(F.count("*").alias(o)))
    if n:
        return Stream(s.df.select(*map(col, g)).distinct().agg(F.count("*").alias(o)))
    out = grouped(s, g, {o: F.count("*")})
    return out.select(g) if d else out


@verb("count-distinct", "-f=f:list -g=g:list -x=x:list -n=n:true -u=u:true -o=o:str")
def count_distinct(s: Stream, f=None, g=None, x=None, n=False, u=False, o="count") -> Stream:
    """Records for each combination of values; with ``u`` for each field on its own (field, value, count); with ``n`` the number of combinations."""
    f = list(f or g or [c for c in s.columns if c not in set(x or ())])
    if u:
        parts = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), col(c).cast("string").alias("value")) for c in f]))
        out = s.df.select(parts.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("count"))
        return Stream.of(out, "field", "value")
    s = s.where(all_present(s, f))
    if n:
        return Stream(s.df.select(*map(col, f)).distinct().agg(F.count("*").alias("count")))
    return grouped(s, f, {o: F.count("*")})


def _frequent(s: Stream, f, n, b, o, most: bool) -> Stream:
    out = grouped(s.where(all_present(s, f)), f, {o: F.count("*")})
    top = out.df.orderBy(col(o).desc() if most else col(o).asc(), *out.by()).limit(n)
    out = out.with_df(top).ordered_by([(col(o), not most)], "count")
    return out.select(f) if b else out


@verb("most-frequent", "-f=f:list -n=n:int -b=b:true -o=o:str")
def most_frequent(s: Stream, f=(), n=10, b=False, o="count") -> Stream:
    """The n most frequent combinations of values; ties by first appearance."""
    return _frequent(s, f, n, b, o, True)


@verb("least-frequent", "-f=f:list -n=n:int -b=b:true -o=o:str")
def least_frequent(s: Stream, f=(), n=10, b=False, o="count") -> Stream:
    """The n least frequent combinations of values."""
    return _frequent(s, f, n, b, o, False)


# ---------------------------------------------------------------- accumulators

PERCENTILE = re.compile(r"p(\d+(?:\.\d+)?)$|median$|first$|last$")


def percentile_of(values: Column, p: float, interpolated: bool) -> Column:
    """Of a sorted array: the element at int(p n / 100), at most the last; or between two (R's type 7)."""
    n = F.size(values)
    if interpolated:
        at = F.lit(p / 100.0) * (n - 1)
        at = F.when(at < 0, F.lit(0.0)).otherwise(at)
        low = F.floor(at).cast("int")
        high = F.least(low + 1, n - 1)
        a, b = F.element_at(values, low + 1).cast("double"), F.element_at(values, high + 1).cast("double")
        return F.when(n > 0, a + (at - low) * (b - a))
    at = F.floor(F.lit(p / 100.0) * n).cast("int")
    return F.when(n > 0, F.element_at(values, F.greatest(F.lit(1), F.least(at + 1, n))))


def exact_percentile(name: str, p: float, interpolated: bool, integral: bool = False) -> Column:
    """An aggregate over a column, by its name: counts of distinct values, pre-aggregated, so no group's values are gathered.

    The element at int(p n) is the discrete percentile, but for p n whole, where that takes the one before: hence a share that is
    greater by less than any other place is away.
    """
    if interpolated:
        return F.percentile(col(name), F.lit(p / 100.0))
    if p >= 100:
        return F.max(col(name))
    got = F.expr(f"percentile_disc({max(0.0, p) / 100.0 + 1e-12!r}D) WITHIN GROUP (ORDER BY {q(name)})")
    return got.cast("bigint") if integral else got


def prepared(s: Stream, fields) -> Stream:
    """With each field's number and text, where it is present and not empty, as columns of their own: they are worked out once."""
    new = {}
    for x in fields:
        ok = nonempty(s, x)
        new[f"_n:{x}"] = F.when(ok, number(s, x))
        new[f"_t:{x}"] = F.when(ok, col(x).cast("string"))
    return s.with_columns(new)


def is_integral(s: Stream, x: str) -> bool:
    return s.dtype(x).simpleString() in ("tinyint", "smallint", "int", "bigint")


def accumulators(v: Column, shown: Column, ok: Column, order: Column | None = None) -> dict[str, Column]:
    """The named accumulators as aggregates: ``v`` the value as a number, ``shown`` as text, ``ok`` where it is present and not empty."""
    x = F.when(ok, v)
    t = F.when(ok, shown)
    d = x.cast("double")
    n = F.count(x)
    skew_top = F.avg(F.pow(d, 3)) - 3 * F.avg(d) * F.avg(d * d) + 2 * F.pow(F.avg(d), 3)
    return {
        "count": F.count(t),
        "sum": F.coalesce(F.sum(x), F.lit(0)),
        "mean": F.avg(d),
        "var": F.var_samp(d),
        "stddev": F.stddev_samp(d),
        "meaneb": F.sqrt(F.var_samp(d) / n),
        "skewness": F.try_divide(skew_top, F.pow(F.var_samp(d), 1.5)),
        "kurtosis": F.kurtosis(d),
        "min": F.min(x),
        "max": F.max(x),
        "minlen": F.min(F.char_length(t)).cast("bigint"),
        "maxlen": F.max(F.char_length(t)).cast("bigint"),
        "null_count": F.count_if(F.coalesce(shown == "", F.lit(False))),
        "distinct_count": F.count_distinct(t),
        "first": F.min_by(x, F.when(ok, order)) if order is not None else F.first(x, ignorenulls=True),
        "last": F.max_by(x, F.when(ok, order)) if order is not None else F.last(x, ignorenulls=True),
    }


def aggregate(s: Stream, names, fields, g, interpolated: bool) -> tuple[dict[str, Column], list[tuple[str, str]]]:
    """Aggregates that are one expression each; and (field, name) of those that need values counted first."""
    out, later = {}, []
    order = s.first_key() if s.order and s.uniform else None
    for x in fields:
        table = accumulators(col(f"_n:{x}"), col(f"_t:{x}"), col(f"_t:{x}").isNotNull(), order)
        words = is_text(s, x)
        if words:  # numbers before texts: the least is a number if there is one, the greatest a text
            v, t = col(f"_n:{x}"), col(f"_t:{x}")
            table["min"] = F.coalesce(shown_number(F.min(v)), F.min(F.when(v.isNull(), t)))
            table["max"] = F.coalesce(F.max(F.when(v.isNull(), t)), shown_number(F.max(v)))
            table["first"] = F.min_by(t, F.when(t.isNotNull(), order)) if order is not None else F.first(t, ignorenulls=True)
            table["last"] = F.max_by(t, F.when(t.isNotNull(), order)) if order is not None else F.last(t, ignorenulls=True)
        for a in names:
            key = f"{x}_{a}"
            if a in ("mode", "antimode", "mad"):
                later.append((x, a))
            elif a == "null_count":
                out[key] = F.count_if(F.coalesce(col(x).cast("string") == "", F.lit(False)))
            elif a in table:
                out[key] = table[a]
            elif not interpolated and (a == "median" or PERCENTILE.fullmatch(a)):
                later.append((x, a))
            elif a == "median" or PERCENTILE.fullmatch(a):
                out[key] = exact_percentile(f"_n:{x}", 50.0 if a == "median" else _float(a[1:]), interpolated, is_integral(s, x))
            else:
                raise ValueError(f"no accumulator {a}")
    return out, later


def shown_number(c: Column) -> Column:
    """A double as text, whole ones without a point."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def value_counts(s: Stream, g, x: str) -> Stream:
    """Per group and value of x: n, and the first place."""
    order = s.first_key() if s.order and s.uniform else F.lit(0)
    keys = [col(k).alias(k) for k in g]
    return Stream(s.df.where(nonempty(s, x)).groupBy(*keys, col(x).cast("string").alias("_v")).agg(F.count("*").alias("_n"), (F.min if not s.order or s.order[0][1] else F.max)(order).alias("_at"), F.first(number(s, x)).alias("_x")))


def percentiles_by_counts(s: Stream, g, x: str, names: list[str]):
    """By group, all the discrete percentiles of a field: values are counted, the counts added up in order of the values (numbers before
    texts), and the values at the wanted places picked; what is sorted spills, and all percentiles take one pass."""
    from ..plans.ordered import running

    keys = [col(k).alias(k) for k in g]
    words = is_text(s, x)
    v = {"_x": col(f"_n:{x}"), "_v": col(f"_t:{x}")} if words else {"_v": col(f"_n:{x}")}
    counts = s.df.where(v["_v"].isNotNull()).groupBy(*keys, *[c.alias(k) for k, c in v.items()]).agg(F.count("*").alias("_n"))
    by = [F.col("_x").isNull(), F.col("_x"), F.col("_v")] if words else [F.col("_v")]
    if g:
        total = s.df.groupBy(*keys).agg(F.count(v["_v"]).alias("_of"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*map(col, g)).orderBy(*by))).join(total, list(g))
    else:
        upto = running(Stream(counts).ordered_by([(c, True) for c in by], "value"), {"_upto": F.col("_n")})
        counts = upto.df.crossJoin(F.broadcast(s.df.agg(F.count(v["_v"]).alias("_of"))))  # one row
    hit = {}
    for name in names:
        place = F.least(F.floor(F.lit((50.0 if name == "median" else _float(name[1:])) / 100.0) * F.col("_of")), F.col("_of") - 1)
        place = F.greatest(place, F.lit(0))
        hit[name] = (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))
    picked = counts.where(functools.reduce(lambda p, q: p | q, hit.values())).groupBy(*[col(k) for k in g])
    return picked.agg(*[F.max(F.when(h, F.col("_v"))).alias(f"{x}_{n}") for n, h in hit.items()])


def _later(s: Stream, g, x: str, a: str):
    """Mode, antimode and mad by group: values are counted first, so no group's values are gathered."""
    counts = value_counts(s, g, x).df
    keys = [col(k).alias(k) for k in g]
    name = f"{x}_{a}"
    if a == "mad":
        w = Window.partitionBy(*keys)
        mean = F.sum(F.col("_x") * F.col("_n")).over(w) / F.sum("_n").over(w)
        return counts.withColumn("_mean", mean).groupBy(*keys).agg((F.sum(F.abs(F.col("_x") - F.col("_mean")) * F.col("_n")) / F.sum("_n")).alias(name))
    first = F.col("_at").asc() if not s.order or s.order[0][1] else F.col("_at").desc()
    counts = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc() if a == "mode" else F.col("_n").asc(), first, "_v")))
    return counts.where("_rank = 1").select(*keys, F.col("_v").alias(name))


@verb("stats1", "-a=a:list -f=f:list -g=g:list --fr=fr:str --fx=fx:str --gr=gr:str --gx=gx:str -i=i:true -s=iterative:true -w=w:int -F=float:true -S=text:true")
def stats1(s: Stream, a=(), f=None, g=(), fr=None, fx=None, gr=None, gx=None, i=False, iterative=False, w=None, float=False, text=False) -> Stream:
    """Accumulators over fields by group; empty values are skipped. ``w``: over the last w records, appended to each."""
    cols = s.columns
    if gr or gx:
        g = [c for c in cols if bool(matcher(gr or gx).search(c)) == bool(gr)]
    if fr or fx:
        f = [c for c in cols if bool(matcher(fr or fx).search(c)) == bool(fr) and c not in g]
    g, f = list(g), [x for x in f if x in cols]
    if w:
        over = s.window(*g).rowsBetween(-(w - 1), 0)
        new = {}
        for x in f:
            for name in a:
                if name == "median" or PERCENTILE.fullmatch(name):
                    p = 50.0 if name == "median" else _float(name[1:])
                    new[f"{x}_{name}"] = percentile_of(F.array_sort(F.collect_list(F.when(nonempty(s, x), number(s, x))).over(over)), p, i)
                else:
                    new[f"{x}_{name}"] = _over(name, s, x, over)
        return s.where(all_present(s, g)).with_columns(new)
    s = s.where(all_present(s, g))
    s = prepared(s, f)
    plain, later = aggregate(s, a, f, g, i)
    out = grouped(s, g, plain or {"_n": F.count("*")})
    ranked = {x: [n for y, n in later if y == x and (n == "median" or PERCENTILE.fullmatch(n))] for x, _ in later}
    parts = [(percentiles_by_counts(s, g, x, names), [f"{x}_{n}" for n in names]) for x, names in ranked.items() if names]
    parts += [(_later(s, g, x, n), [f"{x}_{n}"]) for x, n in later if n not in ranked[x]]
    for part, new in parts:
        if g:
            df = out.df.join(part.select(*[col(k).alias(f"_k{j}") for j, k in enumerate(g)], *map(col, new)), [col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(g)], "left")
            df = df.drop(*[f"_k{j}" for j in range(len(g))])
        else:
            df = _one_row(out.df, part)
        out = out.with_df(df)
    return out.select([*g, *[f"{x}_{n}" for x in f for n in a]])


def _one_row(a, b):
    """Two results of one row each, side by side."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


_float = float


def _over(name: str, s: Stream, x: str, w) -> Column:
    """The accumulator over a window: built anew of window functions."""
    ok = nonempty(s, x)
    v = F.when(ok, number(s, x))
    d = v.cast("double")
    n = F.count(v).over(w)
    simple = {
        "count": lambda: F.count(F.when(ok, F.lit(1))).over(w), "sum": lambda: F.coalesce(F.sum(v).over(w), F.lit(0)), "mean": lambda: F.avg(d).over(w), "min": lambda: F.min(v).over(w),
        "max": lambda: F.max(v).over(w), "var": lambda: F.var_samp(d).over(w), "stddev": lambda: F.stddev_samp(d).over(w), "meaneb": lambda: F.sqrt(F.var_samp(d).over(w) / n),
        "kurtosis": lambda: F.kurtosis(d).over(w), "minlen": lambda: F.min(F.char_length(F.when(ok, col(x).cast("string")))).over(w),
        "maxlen": lambda: F.max(F.char_length(F.when(ok, col(x).cast("string")))).over(w), "null_count": lambda: F.count_if(F.coalesce(col(x).cast("string") == "", F.lit(False))).over(w),
        "distinct_count": lambda: F.size(F.collect_set(F.when(ok, col(x).cast("string"))).over(w)).cast("bigint"), "first": lambda: F.first(v, True).over(w), "last": lambda: F.last(v, True).over(w),
    }
    if name == "skewness":
        m = F.avg(d).over(w)
        return F.try_divide(F.avg(F.pow(d, 3)).over(w) - 3 * m * F.avg(d * d).over(w) + 2 * F.pow(m, 3), F.pow(F.var_samp(d).over(w), 1.5))
    if name in simple:
        return simple[name]()
    seen = F.collect_list(F.when(ok, col(x).cast("string"))).over(w)
    if name == "mad":
        nums = F.collect_list(d).over(w)
        m = F.avg(d).over(w)
        return F.aggregate(F.transform(nums, lambda y: y), F.lit(0.0), lambda acc, y: acc + F.abs(y - m)) / n
    kinds = F.transform(F.array_distinct(seen), lambda k: F.struct(F.size(F.filter(seen, lambda y: y == k)).alias("n"), F.array_position(seen, k).alias("o"), k.alias("v")))
    most = name == "mode"
    best = F.array_sort(kinds, lambda p, r: F.when(p["n"] != r["n"], (r["n"] - p["n"]) if most else (p["n"] - r["n"])).otherwise((p["o"] - r["o"]).cast("int")))
    return F.try_element_at(best, F.lit(1))["v"]


@verb("merge-fields", "-a=a:list -f=f:list -r=r:list -c=c:list -i=i:true -o=o:str -k=k:true -S=text:true -F=float:true")
def merge_fields(s: Stream, a=(), f=None, r=None, c=None, o="name", i=False, k=False, text=False, float=False) -> Stream:
    """Accumulators across the fields of each record: listed (f), matching (r), or by what is left of a name without a part (c)."""
    cols = s.columns
    sets: dict[str, list[str]] = {}
    if f is not None:
        sets[o] = [x for x in f if x in cols]
    elif r is not None:
        ms = [matcher(p) for p in r]
        sets[o] = [x for x in cols if any(m.search(x) for m in ms)]
    else:
        for x in cols:
            for part in c:
                m = matcher(part)
                if m.search(x):
                    sets.setdefault(m.sub("", x, count=1), []).append(x)
                    break
    new, used = {}, []
    for name, fields in sets.items():
        used += fields
        texts = F.filter(F.array(*[F.when(nonempty(s, x), col(x).cast("string")) for x in fields]), lambda y: y.isNotNull()) if fields else F.array().cast("array<string>")
        ints = all(not is_text(s, x) and s.dtype(x).simpleString() in ("int", "bigint", "smallint", "tinyint") for x in fields)
        nums = F.filter(F.array(*[F.when(nonempty(s, x), number(s, x)).cast("bigint" if ints else "double") for x in fields]), lambda y: y.isNotNull()) if fields else F.array().cast("array<double>")
        words = any(is_text(s, x) for x in fields)
        for acc in a:
            if words and acc in ("min", "max"):
                least, most = shown_number(F.array_min(nums)), F.array_max(F.filter(texts, lambda y: text_double(y).isNull()))
                new[f"{name}_{acc}"] = F.coalesce(least, F.array_min(texts)) if acc == "min" else F.coalesce(most, shown_number(F.array_max(nums)))
            else:
                new[f"{name}_{acc}"] = over_array(acc, nums, texts, i, ints and bool(fields))
    out = s.with_columns(new)
    return out if k else out.select([x for x in out.columns if x not in used or x in new])


def over_array(acc: str, nums: Column, texts: Column, interpolated: bool = False, integral: bool = False) -> Column:
    """An accumulator over an array of numbers (and their texts)."""
    n = F.size(nums).cast("bigint")
    d = nums.cast("array<double>")

    def total(f):
        return F.aggregate(d, F.lit(0.0), lambda s_, y: s_ + f(y))

    mean = total(lambda y: y) / n
    var = F.when(n > 1, (total(lambda y: y * y) - n * mean * mean) / (n - 1))
    if acc == "count":
        return F.size(texts).cast("bigint")
    if acc == "sum":
        return F.aggregate(nums, F.lit(0).cast("bigint"), lambda s_, y: s_ + y) if integral else total(lambda y: y)
    if acc == "mean":
        return F.when(n > 0, mean)
    if acc == "var":
        return var
    if acc == "stddev":
        return F.sqrt(var)
    if acc == "meaneb":
        return F.sqrt(var / n)
    if acc == "skewness":
        return F.try_divide(total(lambda y: F.pow(y, 3)) / n - 3 * mean * total(lambda y: y * y) / n + 2 * F.pow(mean, 3), F.pow(var, 1.5))
    if acc == "kurtosis":
        m2 = total(lambda y: y * y) / n - mean * mean
        m4 = total(lambda y: F.pow(y, 4)) / n - 4 * mean * total(lambda y: F.pow(y, 3)) / n + 6 * mean * mean * total(lambda y: y * y) / n - 3 * F.pow(mean, 4)
        return F.try_divide(m4, m2 * m2) - 3
    if acc == "min":
        return F.array_min(nums)
    if acc == "max":
        return F.array_max(nums)
    if acc == "minlen":
        return F.array_min(F.transform(texts, lambda t: F.char_length(t))).cast("bigint")
    if acc == "maxlen":
        return F.array_max(F.transform(texts, lambda t: F.char_length(t))).cast("bigint")
    if acc == "null_count":
        return F.lit(0).cast("bigint")
    if acc == "distinct_count":
        return F.size(F.array_distinct(texts)).cast("bigint")
    if acc == "mad":
        return F.when(n > 0, F.aggregate(d, F.lit(0.0), lambda s_, y: s_ + F.abs(y - mean)) / n)
    if acc in ("mode", "antimode"):
        kinds = F.transform(F.array_distinct(texts), lambda t: F.struct(F.size(F.filter(texts, lambda y: y == t)).alias("n"), F.array_position(texts, t).alias("o"), t.alias("v")))
        sign = 1 if acc == "mode" else -1
        best = F.array_sort(kinds, lambda p, r: F.when(p["n"] != r["n"], (r["n"] - p["n"]) * sign).otherwise((p["o"] - r["o"]).cast("int")))
        return F.try_element_at(best, F.lit(1))["v"]
    if acc == "first":
        return F.try_element_at(nums, F.lit(1))
    if acc == "last":
        return F.try_element_at(nums, F.lit(-1))
    if acc == "median" or PERCENTILE.fullmatch(acc):
        return percentile_of(F.array_sort(nums), 50.0 if acc == "median" else _float(acc[1:]), interpolated)
    raise ValueError(f"no accumulator {acc}")


@verb("histogram", "-f=f:list --lo=lo:float --hi=hi:float --nbins=nbins:int --auto=auto:true -o=o:str -s=spark:true")
def histogram(s: Stream, f=(), lo=None, hi=None, nbins=10, auto=False, o="", spark=False) -> Stream:
    """Counts of values in bins of equal width; a value that is hi counts in the last one. ``auto``: from the least to the greatest of all fields."""
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("f"), number(s, x).cast("double").alias("v")) for x in f]))
    long = s.df.select(values.alias("p")).select("p.*").where("v IS NOT NULL")
    if auto:
        lo, hi = long.agg(F.min("v"), F.max("v")).first()
        if lo is None:
            lo, hi = 0.0, 1.0
    width = (hi - lo) / nbins
    mul = nbins / (hi - lo) if hi > lo else 0.0
    at = F.when((F.col("v") >= lo) & (F.col("v") < hi), F.floor((F.col("v") - lo) * mul)).when(F.col("v") == hi, F.lit(nbins - 1)).cast("bigint")
    binned = long.withColumn("bin", F.least(at, F.lit(nbins - 1))).where("bin IS NOT NULL").groupBy("bin").agg(*[F.count_if(F.col("f") == x).alias(f"{x}_count") for x in f])
    frame = s.df.sparkSession.range(nbins).select(F.col("id").alias("bin"))
    out = frame.join(binned, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias(f"{o}bin_lo"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias(f"{o}bin_hi"),
        *[F.coalesce(col(f"{x}_count"), F.lit(0)).alias(f"{o}{x}_count") for x in f],
    )
    if spark:
        from .statistics import ticks

        counts = out.groupBy().agg(*[F.array_sort(F.collect_list(F.struct("bin", col(f"{o}{x}_count")))).alias(x) for x in f])
        rows = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), ticks(F.transform(col(x), _field(f"{o}{x}_count"))).alias("sparkline")) for x in f]))
        return Stream(counts.select(rows.alias("p")).select("p.*"))
    return Stream(out.withColumnRenamed("bin", f"{HIDDEN}bin"), ((f"{HIDDEN}bin", True),))


def _field(name: str):
    return lambda r: r[name].cast("double")


#: The summaries in their order, and those that are shown unasked.
SUMMARIES = (
    "field_type", "count", "null_count", "distinct_count", "mode", "sum", "mean", "stddev", "var", "skewness", "minlen", "maxlen", "min", "p25", "median", "p75", "max", "iqr", "lof", "lif", "uif", "uof",
)


DEFAULT_SUMMARY = ("field_type", "count", "mean", "min", "max", "null_count", "distinct_count")


def _type_name(s: Stream, x: str) -> Column:
    """The joined type names of a field's values, in one aggregate."""
    t = s.dtype(x).simpleString()
    if is_text(s, x):
        from ..plans.stream import text_long

        kind = F.when(col(x) == "", "empty").when(text_long(col(x)).isNotNull(), "int").when(number(s, x).isNotNull(), "float").when(col(x).isNotNull(), "string")
        return F.array_join(F.array_sort(F.collect_set(kind)), "-")
    name = {"double": "float", "float": "float", "boolean": "boolean", "binary": "bytes"}.get(t, "int" if t in ("int", "bigint", "smallint", "tinyint") else "string")
    return F.when(F.count(col(x)) > 0, F.lit(name)).otherwise(F.lit(""))


@verb("summary", "-a=a:list -x=x:list --all=every:true --transpose=transpose:true")
def summary(s: Stream, a=None, x=None, every=False, transpose=False) -> Stream:
    """One record for each field with the asked summaries (texts); empty values count.

    One aggregation over all fields at once, then one row a field.
    """
    names = [n for n in SUMMARIES if (n in a if a else n not in x if x else every or n in DEFAULT_SUMMARY)]
    cols = s.columns
    order = s.first_key() if s.order and s.uniform else None
    p = s.with_columns({f"_n:{c}": number(s, c) for c in cols})
    aggs = []
    for i, c in enumerate(cols):
        v, t = col(f"_n:{c}"), col(c).cast("string")
        table = accumulators(v, t, present(s, c), order)
        words = F.max(F.when(v.isNull(), t))
        pick = {
            "field_type": lambda c=c: _type_name(s, c), "count": lambda c=c: F.count(col(c)), "min": lambda v=v, t=t: F.coalesce(F.min(v).cast("string"), F.min(t)),
            "max": lambda v=v, words=words: F.coalesce(words, F.max(v).cast("string")), "null_count": lambda t=t: F.count_if(F.coalesce(t == "", F.lit(False))),
        }
        whole = is_integral(s, c)
        for n in names:
            if n in ("p25", "median", "p75", "iqr", "lof", "lif", "uif", "uof"):
                q1, q2, q3 = (exact_percentile(f"_n:{c}", share, False, whole) for share in (25, 50, 75))
                e = {"p25": q1, "median": q2, "p75": q3, "iqr": q3 - q1, "lof": q1 - 3.0 * (q3 - q1), "lif": q1 - 1.5 * (q3 - q1), "uif": q3 + 1.5 * (q3 - q1), "uof": q3 + 3.0 * (q3 - q1)}[n]
            elif n in ("mode", "distinct_count"):
                continue
            else:
                e = pick[n]() if n in pick else table[n]
            aggs.append(e.cast("string").alias(f"{i}:{n}"))
    wide = p.df.agg(*aggs) if aggs else s.df.sparkSession.range(1).select()
    if "mode" in names or "distinct_count" in names:
        # values are counted by field first, all fields in one pass
        at = order if order is not None else F.lit(0)
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
        by_value = s.df.select(cells.alias("p"), at.alias("o")).select("p.*", "o").where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"), F.min("o").alias("o"))
        kinds = by_value.groupBy("i").agg(F.count("*").cast("string").alias("d"), F.max("n").alias("n"))
        best = by_value.join(kinds.select("i", "n"), ["i", "n"]).groupBy("i").agg(F.min_by("v", F.struct("o", "v")).alias("m"))
        both = kinds.join(best, "i").groupBy().agg(*[x for i in range(len(cols)) for x in (F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"{i}:distinct_count"), F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"{i}:mode"))])
        wide = _one_row(wide, both)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(c).alias("field_name"), *[F.col(f"`{i}:{n}`").alias(n) for n in names]) for i, c in enumerate(cols)]))
    out = Stream.of(wide.select(rows.alias("p")).select("p.*"), "_i").select(["field_name", *names])
    if transpose:
        flat = out.df.select("field_name", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("summary"), F.col(n).alias("v")) for k, n in enumerate(names)])).alias("p")).select("field_name", "p.*")
        wide = flat.groupBy("k", "summary").pivot("field_name", cols).agg(F.first("v"))
        return Stream.of(wide, "k").select([F.col("summary").alias("field_name"), *cols])
    return out


@verb("describe", "-n|--max-values=n:int")
def describe(s: Stream, n=20) -> Stream:
    """One record for each field: types with counts, count, null_count, distinct_count, min, max, and its values if they are n or fewer.

    Values are counted first, by field and value; only fields with n or fewer distinct ones have them listed.
    """
    from ..plans.stream import text_double, text_long

    cols = s.columns
    order = s.first_key() if s.order and s.uniform else F.lit(0)
    typed = {c: {"double": "float", "float": "float", "boolean": "boolean"}.get(s.dtype(c).simpleString(), "int" if s.dtype(c).simpleString() in ("int", "bigint") else None) for c in cols}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("field_name"), F.lit(typed[c]).cast("string").alias("t"), col(c).cast("string").alias("v"), order.alias("o")) for i, c in enumerate(cols)]))
    long = s.df.select(cells.alias("p")).select("p.*").where("v IS NOT NULL")
    v = F.col("v")
    kind = F.coalesce(F.col("t"), F.when(v == "", "empty").when(text_long(v).isNotNull(), "int").when(text_double(v).isNotNull(), "float").otherwise("string"))
    by_value = long.groupBy("i", "field_name", "v").agg(F.first(kind).alias("kind"), F.count("*").alias("c"), F.min("o").alias("o")).withColumn("x", text_double(v))
    kinds = by_value.groupBy("i", "kind").agg(F.sum("c").alias("c")).groupBy("i").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "c")))).alias("types"))
    least, most = F.coalesce(F.min_by("v", "x"), F.min("v")), F.coalesce(F.max(F.when(F.col("x").isNull(), v)), F.max_by("v", "x"))
    w = Window.partitionBy("i").orderBy("o", "v")
    few = by_value.withColumn("r", F.row_number().over(w)).groupBy("i", "field_name").agg(
        F.sum("c").alias("count"), F.sum(F.when(v == "", F.col("c")).otherwise(0)).alias("null_count"), F.count("*").alias("distinct_count"), least.alias("min"), most.alias("max"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= n, F.struct("r", "v")))).alias("seen"),
    )
    out = few.join(kinds, "i").select("i", "field_name", "types", "count", "null_count", "distinct_count", "min", "max", F.when(F.col("distinct_count") <= n, F.transform("seen", lambda r: r["v"])).alias("values"))
    return Stream.of(out, "i").select(["field_name", "types", "count", "null_count", "distinct_count", "min", "max", "values"])

