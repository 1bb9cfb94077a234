"""The function table of the expression language: each name with its argument counts and a builder of Columns.

A value is a Column with a kind that is known when the plan is made: int, float, str, bool, map, array, bytes, any
(text that may be a number: a text column), or absent. NULL is absent; ``''`` is empty.
"""

from __future__ import annotations

import dataclasses
import datetime
import math
import os
import platform
import re
import socket
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import over_array, percentile_of
from ..operators.statistics import ticks
from ..operators.textual import clean, formatted, gmt, sentence, ssub_first, sub_first
from ..operators.windows import natural_key
from ..plans.stream import java_regex, java_replacement, text_double, text_long

STARTED = time.time()


@dataclasses.dataclass(frozen=True)
class Val:
    c: Column
    kind: str
    #: The Spark type, where the kind does not tell it.
    type: T.DataType | None = None
    #: The value itself, for literals.
    literal: object = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.MapType, T.StructType)):
        return "map"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.StringType):
        return "any"
    return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "any"


def lit(v) -> Val:
    if isinstance(v, bool):
        return Val(F.lit(v), "bool", literal=v)
    if isinstance(v, int):
        return Val(F.lit(v).cast("bigint"), "int", literal=v)
    if isinstance(v, float):
        return Val(F.lit(v), "float", literal=v)
    if v is None:
        return Val(F.lit(None).cast("string"), "absent")
    return Val(F.lit(v), "str", literal=v)


def num(v: Val) -> Column:
    """As a number; text that is none is NULL."""
    if v.numeric:
        return v.c
    if v.kind in ("any", "str"):
        return text_double(v.c)
    if v.kind == "time":
        return F.unix_micros(v.c.cast("timestamp")) / 1e6
    if v.kind == "bool":
        return F.lit(None).cast("double")
    return F.lit(None).cast("double")


def dbl(v: Val) -> Column:
    return num(v).cast("double")


def lng(v: Val) -> Column:
    return text_long(v.c) if v.kind in ("any", "str") else num(v).cast("bigint")


def txt(v: Val) -> Column:
    if v.kind == "float":
        whole = (v.c == F.floor(v.c)) & (F.abs(v.c) < 1e15)
        return F.when(whole, v.c.cast("bigint").cast("string")).otherwise(v.c.cast("string"))
    if v.kind in ("map", "array"):
        return F.to_json(v.c)
    if v.kind == "bytes":
        return F.decode(v.c, "UTF-8")
    return v.c.cast("string")


def boolean(v: Val) -> Column:
    if v.kind == "bool":
        return v.c
    return F.when(v.c.cast("string") == "true", True).when(v.c.cast("string") == "false", False) if v.kind in ("any", "str", "absent") else F.lit(None).cast("boolean")


def empty(v: Val) -> Column:
    """Empty: a text of no length."""
    return F.coalesce(v.c == "", F.lit(False)) if v.kind in ("any", "str") else F.lit(False)


def S(c: Column) -> Val:
    return Val(c, "str")


def I(c: Column) -> Val:  # noqa: E743
    return Val(c.cast("bigint"), "int")


def D(c: Column) -> Val:
    return Val(c.cast("double"), "float")


def B(c: Column) -> Val:
    return Val(c, "bool")


# ---------------------------------------------------------------- arithmetic


def _combine(a: Val, b: Val, ints: Callable, floats: Callable) -> Val:
    """Absent and empty operands leave the other one, as do texts that are no numbers. Integers stay integers; a result beyond 64 bits is NULL, as a column has one type."""
    if a.kind == "absent":
        return b
    if b.kind == "absent":
        return a
    if a.kind == "int" and b.kind == "int":
        return Val(F.when(a.c.isNull(), b.c).when(b.c.isNull(), a.c).otherwise(ints(a.c, b.c)), "int")
    x, y = dbl(a), dbl(b)
    return D(F.coalesce(floats(x, y), x, y))


def plus(a: Val, b: Val) -> Val:
    return _combine(a, b, F.try_add, lambda x, y: x + y)


def minus(a: Val, b: Val) -> Val:
    return _combine(a, b, F.try_subtract, lambda x, y: x - y)


def times(a: Val, b: Val) -> Val:
    return _combine(a, b, F.try_multiply, lambda x, y: x * y)


def ieee_divide(x: Column, y: Column) -> Column:
    zero = F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def divide(a: Val, b: Val) -> Val:
    """A float; absent over a number is 0, a number over absent itself."""
    if b.kind == "absent":
        return a
    x, y = dbl(a), dbl(b)
    return D(F.when(x.isNull() & y.isNotNull() & ~empty(a), F.lit(0.0)).when(y.isNull() & ~empty(b), x).otherwise(ieee_divide(x, y)))


def floor_divide(a: Val, b: Val) -> Val:
    if a.kind == b.kind == "int":
        return I(F.when(b.c != 0, F.floor(a.c.cast("decimal(38,0)") / b.c.cast("decimal(38,0)")).cast("bigint")))
    x, y = dbl(a), dbl(b)
    return D(F.when(y == 0, ieee_divide(x, y)).otherwise(F.floor(F.try_divide(x, y)).cast("double")))


def modulus(a: Val, b: Val) -> Val:
    """The remainder with the sign of the modulus."""
    x, y = num(a), num(b)
    r = F.when(y != 0, x - y * F.floor(x.cast("double") / y.cast("double")))
    if a.kind == b.kind == "int":
        m = F.when(y != 0, F.try_mod(F.try_mod(x, y) + y, y))
        return I(m)
    return D(r)


def power(a: Val, b: Val) -> Val:
    if a.kind == "int" and isinstance(b.literal, int) and 0 <= b.literal <= 8:
        out = F.lit(1).cast("bigint")
        for _ in range(b.literal):
            out = F.try_multiply(out, a.c)
        return I(out)
    return D(F.pow(dbl(a), dbl(b)))


def dot(a: Val, b: Val) -> Val:
    return S(F.concat(F.coalesce(txt(a), F.lit("")), F.coalesce(txt(b), F.lit(""))))


def _wrap(op: str) -> Callable:
    """64-bit arithmetic that wraps: done in decimals, then folded."""

    def run(a: Val, b: Val) -> Val:
        x, y = (num(v).cast("bigint").cast("decimal(38,0)") for v in (a, b))
        r = {"+": x + y, "-": x - y, "*": x * y}[op]
        two = F.lit("18446744073709551616").cast("decimal(38,0)")
        m = F.pmod(r.cast("decimal(38,0)"), two)
        return I(F.when(m >= F.lit("9223372036854775808").cast("decimal(38,0)"), m - two).otherwise(m).cast("bigint"))

    return run


def negate(a: Val) -> Val:
    return Val(-num(a), a.kind if a.numeric else "float")


def positive(a: Val) -> Val:
    return a if a.numeric else D(dbl(a))


# ---------------------------------------------------------------- comparison


def _compare(op: str) -> Callable:
    ops = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    f = ops[op]

    def run(a: Val, b: Val) -> Val:
        if a.numeric and b.numeric:
            return B(f(a.c, b.c))
        if a.kind == "time" and b.kind == "time" or a.kind == b.kind == "bool":
            return B(f(a.c, b.c))
        if "str" in (a.kind, b.kind) and not (a.kind == "any" or b.kind == "any") or a.kind == b.kind == "str":
            return B(f(txt(a), txt(b)))
        if a.literal is not None and a.kind == "str" and text_number(a.literal) is None or b.literal is not None and b.kind == "str" and text_number(b.literal) is None:
            return B(f(txt(a), txt(b)))
        x, y = dbl(a), dbl(b)
        return B(F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(txt(a), txt(b))))

    return run


def text_number(s: str):
    try:
        return float(s) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", s) and not re.fullmatch(r"[-+]?0\d+", s) else None
    except ValueError:
        return None


def spaceship(a: Val, b: Val) -> Val:
    less, same = _compare("<")(a, b).c, _compare("==")(a, b).c
    return I(F.when(less, -1).when(same, 0).otherwise(1))


def _logic(op: str) -> Callable:
    def run(a: Val, b: Val) -> Val:
        if a.kind == "absent":
            return b
        if b.kind == "absent":
            return a
        x, y = boolean(a), boolean(b)
        if op == "&&":
            return B(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x & y))
        if op == "||":
            return B(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x | y))
        return B(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x != y))

    return run


def merged(a: Val, b: Val) -> tuple[Column, Column, str]:
    """Two values brought to one type."""
    if a.kind == "absent":
        return F.lit(None), b.c, b.kind
    if b.kind == "absent":
        return a.c, F.lit(None), a.kind
    if a.kind == b.kind:
        return a.c, b.c, a.kind
    if a.numeric and b.numeric:
        return a.c.cast("double"), b.c.cast("double"), "float"
    return txt(a), txt(b), "any" if "any" in (a.kind, b.kind) or a.numeric or b.numeric else "str"


def absent_or(a: Val, b: Val) -> Val:
    x, y, k = merged(a, b)
    return Val(F.coalesce(x, y), k, a.type or b.type)


def absent_empty_or(a: Val, b: Val) -> Val:
    x, y, k = merged(a, b)
    return Val(F.when(a.c.isNull() | empty(a), y).otherwise(x), k, a.type or b.type)


def ternary(p: Val, a: Val, b: Val) -> Val:
    x, y, k = merged(a, b)
    return Val(F.when(boolean(p), x).otherwise(y), k, a.type or b.type)


# ---------------------------------------------------------------- helpers for the tables


def _d1(f: Callable) -> Callable:
    return lambda a: D(f(dbl(a)))


def _same_kind(ints: Callable, floats: Callable) -> Callable:
    """Integers stay integers."""
    return lambda a: I(ints(a.c)) if a.kind == "int" else D(floats(dbl(a)))


def _mapped(f: Callable[[float], float], x: pd.Series) -> pd.Series:
    """A function of the C library or its like over an array of doubles; NaN stays."""
    out = np.full(len(x), np.nan)
    some = x.notna().to_numpy()
    out[some] = np.frompyfunc(f, 1, 1)(x.to_numpy(np.float64)[some]).astype(np.float64)
    return pd.Series(out, index=x.index)


@F.pandas_udf(T.DoubleType())
def _erf(x: pd.Series) -> pd.Series:
    return _mapped(math.erf, x)


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return _mapped(math.erfc, x)


@F.pandas_udf(T.DoubleType())
def _invqnorm(x: pd.Series) -> pd.Series:
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    inside = x.where((x > 0) & (x < 1))
    return _mapped(inv, inside).fillna(0.0).where(x.notna())


@F.pandas_udf(T.LongType())
def _mexp(a: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) or pd.isna(z) or z == 0 else pow(int(x), int(y), int(z)) for x, y, z in zip(a, b, m)], dtype="Int64")


def _modular(op: str) -> Callable:
    def run(a: Val, b: Val, m: Val) -> Val:
        x, y, z = (num(v).cast("bigint").cast("decimal(38,0)") for v in (a, b, m))
        r = {"+": x + y, "-": x - y, "*": x * y}[op]
        return I(F.pmod(r.cast("decimal(38,0)"), z).cast("bigint"))

    return run


def _bits(f: Callable) -> Callable:
    return lambda a, b: I(f(lng(a), lng(b)))


def _shift(name: str) -> Callable:
    return lambda a, b: I(F.call_function(name, lng(a), lng(b).cast("int")))


def _round(c: Column) -> Column:
    """Half away from zero."""
    return F.when(c < 0, -F.floor(-c + 0.5)).otherwise(F.floor(c + 0.5)).cast("double")


def roundm(a: Val, m: Val) -> Val:
    r = _round(dbl(a) / dbl(m))
    return I(r * lng(m)) if a.kind == m.kind == "int" else D(r * dbl(m))


def _extreme(most: bool) -> Callable:
    """Numbers before booleans before empty before texts: the least is a number if there is one, the greatest a text."""

    def run(*vals: Val) -> Val:
        vals = [v for v in vals if v.kind != "absent"]
        if not vals:
            return lit(None)
        if len(vals) == 1:
            return vals[0]
        pick = F.greatest if most else F.least
        if all(v.numeric for v in vals):
            if all(v.kind == "int" for v in vals):
                return I(pick(*[v.c for v in vals]))
            return D(pick(*[dbl(v) for v in vals]))
        if all(v.kind == "str" for v in vals):
            return S(pick(*[v.c for v in vals]))
        numbers = pick(*[dbl(v) for v in vals])
        texts = pick(*[F.when(dbl(v).isNull(), txt(v)) for v in vals])
        shown = txt(D(numbers))
        return Val(F.coalesce(texts, shown) if most else F.coalesce(shown, texts), "any")

    return run


def _sub(how: Callable) -> Callable:
    def run(a: Val, old: Val, new: Val) -> Val:
        if old.literal is None or new.literal is None:
            raise ValueError("a pattern and its replacement must be literals")
        return S(how(txt(a), old.literal, new.literal))

    return run


def _gsub(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, java_regex(old), java_replacement(new))


def _pattern(v: Val) -> str:
    if not isinstance(v.literal, str):
        raise ValueError("a pattern must be a literal")
    return java_regex(v.literal)


def substr1(a: Val, m: Val, n: Val) -> Val:
    """From place m to n, counted from 1, or from the end below 0; out of bounds is empty."""
    c, size = txt(a), F.char_length(txt(a))
    lo, hi = (F.when(lng(v) < 0, lng(v) + size + 1).otherwise(lng(v)) for v in (m, n))
    ok = (lo >= 1) & (hi <= size) & (lo <= hi)
    return S(F.when(c.isNotNull(), F.when(ok, F.substring(c, lo.cast("int"), (hi - lo + 1).cast("int"))).otherwise(F.lit(""))))


def substr0(a: Val, m: Val, n: Val) -> Val:
    up = lambda v: Val(F.when(lng(v) < 0, lng(v)).otherwise(lng(v) + 1), "int")
    return substr1(a, up(m), up(n))


def _pad(left: bool) -> Callable:
    """Whole pads only, never beyond the length, never cutting."""

    def run(a: Val, n: Val, pad: Val) -> Val:
        c = txt(a)
        times_ = F.greatest(F.lit(0), F.floor((lng(n) - F.char_length(c)) / F.char_length(txt(pad)))).cast("int")
        more = F.repeat(txt(pad), times_)
        return S(F.concat(more, c) if left else F.concat(c, more))

    return run


def format_text(fmt: Val, *args: Val) -> Val:
    parts, used, out = re.split(r"(\{[^}]*\})", fmt.literal), 0, []
    for p in parts:
        if p.startswith("{") and p.endswith("}"):
            inner = p[1:-1]
            name, _, spec = inner.partition(":")
            if name.isdigit():
                k = int(name) - 1
            else:
                k, used = used, used + 1
            v = args[k] if 0 <= k < len(args) else lit("")
            out.append(F.coalesce(txt(fmtnum(v, lit(spec))) if spec.startswith("%") else txt(v), F.lit("")))
        elif p:
            out.append(F.lit(p))
    return S(F.concat(*out) if out else F.lit(""))


def _unformat(infer: bool) -> Callable:
    def run(fmt: Val, a: Val) -> Val:
        pieces = re.split(r"<>|\{[^}]*\}", fmt.literal)
        regex = "^" + "(.*?)".join(re.escape(p) for p in pieces) + "$"
        n = len(pieces) - 1
        got = F.array(*[F.regexp_extract(txt(a), regex, i + 1) for i in range(n)])
        return Val(F.when(txt(a).rlike(regex), got), "array", T.ArrayType(T.StringType()))

    return run


def fmtnum(a: Val, fmt: Val) -> Val:
    v = num(a)
    f = fmt.literal
    if a.kind in ("any", "str"):
        whole = text_long(a.c)
        return S(F.when(whole.isNotNull(), formatted(whole, f, True)).otherwise(formatted(v, f, False)))
    return S(formatted(v, f, a.kind == "int"))


def fmtifnum(a: Val, fmt: Val) -> Val:
    return S(F.when(num(a).isNotNull(), fmtnum(a, fmt).c).otherwise(txt(a)))


def strmatchx(a: Val, p: Val) -> Val:
    regex = _pattern(p)
    c, groups = txt(a), re.compile(re.sub(r"^\(\?i\)", "", regex)).groups
    hit = c.rlike(regex)
    start = F.regexp_instr(c, F.lit(regex))
    full = F.regexp_extract(c, regex, 0)
    entries = [("matched", hit.cast("string")), ("full_capture", F.when(hit, full)), ("full_start", F.when(hit, start).cast("string")), ("full_end", F.when(hit, start + F.char_length(full) - 1).cast("string"))]
    entries += [(f"capture_{i}", F.when(hit, F.regexp_extract(c, regex, i))) for i in range(1, groups + 1)]
    m = F.create_map(*[x for k, v in entries for x in (F.lit(k), v)])
    return Val(F.map_filter(m, lambda k, v: v.isNotNull()), "map", T.MapType(T.StringType(), T.StringType()))


# ---------------------------------------------------------------- collections


def as_map(v: Val) -> Column:
    """A map of texts."""
    if isinstance(v.type, T.StructType):
        return F.create_map(*[x for n in v.type.names for x in (F.lit(n), v.c.getField(n).cast("string"))])
    return v.c


def elements(v: Val) -> Column:
    return v.c if v.kind == "array" else F.map_values(as_map(v))


def element_kind(v: Val) -> str:
    if isinstance(v.type, T.ArrayType):
        return kind_of(v.type.elementType)
    return kind_of(v.type.valueType) if isinstance(v.type, T.MapType) else "any"


def numbers(v: Val) -> Column:
    k = element_kind(v)
    out = elements(v) if k in ("int", "float") else F.transform(elements(v), lambda x: text_double(x.cast("string")))
    return F.filter(out, lambda x: x.isNotNull())


def _stat(acc: str) -> Callable:
    def run(v: Val) -> Val:
        texts = F.transform(elements(v), lambda x: x.cast("string"))
        c = over_array(acc, numbers(v), texts)
        if acc in ("count", "distinct_count", "minlen", "maxlen"):
            return I(c)
        return Val(c, "any") if acc in ("mode", "antimode") else D(c)

    return run


def _power_sum(k: int) -> Callable:
    return lambda v: D(F.aggregate(numbers(v).cast("array<double>"), F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(k))))


def percentile(v: Val, p: Val, options: Val | None = None) -> Val:
    share = float(p.literal)
    inter = bool(options is not None and isinstance(options.literal, dict) and options.literal.get("interpolate_linearly"))
    c = percentile_of(F.array_sort(numbers(v)), share, inter)
    return Val(c, "float" if inter or element_kind(v) != "int" else "int")


def percentiles(v: Val, ps: Val, options: Val | None = None) -> Val:
    wanted = ps.literal if isinstance(ps.literal, (list, tuple)) else [ps.literal]
    each = [(str(p), percentile(v, lit(p), options)) for p in wanted]
    t = T.LongType() if each and all(x.kind == "int" for _, x in each) else T.DoubleType()
    return Val(F.create_map(*[x for name, value in each for x in (F.lit(name), value.c.cast(t))]), "map", T.MapType(T.StringType(), t))


def sort_by_flags(v: Val, flags: str = "") -> Val:
    down = "r" in flags
    if v.kind == "map":
        m = as_map(v)
        keys = F.array_sort(F.map_keys(m))
        keys = F.reverse(keys) if down else keys
        return Val(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(m, k))), "map", v.type)
    arr = v.c
    if "c" in flags:
        key = lambda x: F.lower(x.cast("string"))
    elif "t" in flags:
        key = lambda x: natural_key(x.cast("string"))
    elif "f" in flags:
        key = lambda x: x.cast("string")
    elif element_kind(v) in ("int", "float"):
        key = lambda x: x
    else:
        key = lambda x: F.struct(F.when(text_double(x).isNull(), 1).otherwise(0).alias("r"), text_double(x).alias("n"), x.alias("t"))
    pairs = F.array_sort(F.transform(arr, lambda x: F.struct(key(x).alias("k"), x.alias("v"))))
    out = F.transform(F.reverse(pairs) if down else pairs, lambda p: p["v"])
    return Val(out, "array", v.type)


def splitter(a: Val, sep: Val) -> Column:
    c = txt(a)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, re.escape(sep.literal), -1))


STRINGS = T.ArrayType(T.StringType())
TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _splitkv(a: Val, ps: Val, fs: Val) -> Val:
    return Val(F.str_to_map(txt(a), F.lit(re.escape(fs.literal)), F.lit(re.escape(ps.literal))), "map", TEXT_MAP)


def _splitnv(a: Val, sep: Val) -> Val:
    parts = splitter(a, sep)
    keys = F.transform(parts, lambda x, i: (i + 1).cast("string"))
    return Val(F.map_from_arrays(keys, parts), "map", TEXT_MAP)


def _keys_of(args: tuple[Val, ...]) -> list[str]:
    out: list[str] = []
    for a in args:
        out += [str(x) for x in a.literal] if isinstance(a.literal, (list, tuple)) else [str(a.literal)]
    return out


def _map_type(v: Val):
    return v.type if isinstance(v.type, T.MapType) else TEXT_MAP


def mapsum(*ms: Val) -> Val:
    if not ms:
        return Val(F.create_map().cast("map<string,string>"), "map", TEXT_MAP)
    out = as_map(ms[0])
    for m in ms[1:]:
        n = as_map(m)
        out = F.map_concat(F.map_filter(out, _lacks(F.map_keys(n))), n)
    return Val(out, "map", _map_type(ms[0]))


def _lacks(keys: Column) -> Callable:
    return lambda k, v: ~F.array_contains(keys, k)


def mapdiff(*ms: Val) -> Val:
    out = as_map(ms[0])
    for m in ms[1:]:
        out = F.map_filter(out, _lacks(F.map_keys(as_map(m))))
    return Val(out, "map", _map_type(ms[0]))


def concat_arrays(*vs: Val) -> Val:
    vs = [v for v in vs if v.kind != "absent"]
    return Val(F.concat(*[v.c if v.kind == "array" else F.array(v.c) for v in vs]), "array", next((v.type for v in vs if v.kind == "array"), STRINGS))


def haskey(v: Val, k: Val) -> Val:
    if v.kind == "map":
        return B(F.map_contains_key(as_map(v), txt(k)))
    n = F.size(v.c)
    return B(((lng(k) >= 1) & (lng(k) <= n)) | ((lng(k) <= -1) & (lng(k) >= -n)))


def length(v: Val) -> Val:
    if v.kind == "absent":
        return lit(0)
    if v.kind == "array":
        return I(F.coalesce(F.size(v.c), F.lit(0)))
    if v.kind == "map":
        return I(F.coalesce(F.size(as_map(v)), F.lit(0)))
    return I(F.when(v.c.isNull(), 0).otherwise(1))


def _depth(t: T.DataType | None) -> int:
    if isinstance(t, T.ArrayType):
        return 1 + _depth(t.elementType)
    if isinstance(t, T.MapType):
        return 1 + _depth(t.valueType)
    if isinstance(t, T.StructType):
        return 1 + max([_depth(f.dataType) for f in t.fields], default=0)
    return 0


def leafcount(v: Val) -> Val:
    def count(c: Column, t) -> Column:
        if isinstance(t, T.ArrayType):
            return F.aggregate(c, F.lit(0), lambda s, x: s + count(x, t.elementType)) if _depth(t.elementType) else F.size(c)
        if isinstance(t, T.MapType):
            return F.aggregate(F.map_values(c), F.lit(0), lambda s, x: s + count(x, t.valueType)) if _depth(t.valueType) else F.size(c)
        if isinstance(t, T.StructType):
            out = F.lit(0)
            for f in t.fields:
                out = out + count(c.getField(f.name), f.dataType)
            return out
        return F.lit(1)

    return I(count(v.c, v.type))


def json_text(v: Val) -> Val:
    if v.kind in ("map", "array"):
        return S(F.to_json(v.c))
    if v.numeric or v.kind == "bool":
        return S(txt(v))
    one = F.to_json(F.array(txt(v)))
    return S(F.substring(one, F.lit(2), F.char_length(one) - 2))


# ---------------------------------------------------------------- time

#: C time formats and the patterns of the same meaning on the JVM.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "e": "d", "F": "yyyy-MM-dd",
    "T": "HH:mm:ss", "D": "MM/dd/yy", "Z": "zzz", "z": "xx", "R": "HH:mm",
}


def _pattern_parts(fmt: str):
    for m in re.finditer(r"%([1-9])S|%([A-Za-z%])|([^%]+)", fmt):
        if m[1]:
            yield "frac", int(m[1])
        elif m[2]:
            yield ("text", "%") if m[2] == "%" else ("code", m[2])
        else:
            yield "text", m[3]


def offset_of(at: Column, zone: str | None) -> Column:
    """Seconds by which the zone is ahead of UTC at a time that is given in UTC."""
    return F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at) if zone else F.lit(0)


def zone_name(at: Column, zone: str | None) -> Column:
    """The zone's abbreviation, in summer that of summer time, or its offset where it has none."""
    from zoneinfo import ZoneInfo

    if not zone or zone.upper() in ("UTC", "GMT", "ETC/UTC"):
        return F.lit("UTC")
    # a zone's abbreviations by its offsets, as of recent years
    names = {}
    for month in range(1, 13):
        t = datetime.datetime(2024, month, 15, 12, tzinfo=ZoneInfo(zone))
        names[int(t.utcoffset().total_seconds())] = t.tzname()
    o = offset_of(at, zone)
    shown = zone_offset(o)
    for seconds, name in names.items():
        shown = F.when(o == seconds, name).otherwise(shown)
    return shown


def zone_offset(seconds: Column) -> Column:
    return F.format_string("%s%02d%02d", F.when(seconds < 0, "-").otherwise("+"), F.floor(F.abs(seconds) / 3600), F.floor(F.abs(seconds) / 60) % 60)


def parts_of(seconds: Column) -> tuple[Column, Column]:
    """Whole seconds, and the nanoseconds above them."""
    exact = seconds.cast("decimal(29,9)")
    whole = F.floor(exact).cast("bigint")
    return whole, ((exact - whole).cast("decimal(10,9)") * 1000000000).cast("bigint")


def parts_of_nanos(nanos: Column) -> tuple[Column, Column]:
    below = F.pmod(nanos, F.lit(1000000000).cast("bigint"))
    return F.call_function("div", nanos - below, F.lit(1000000000).cast("bigint")), below


def strftime(seconds: Column, fmt: str, zone: str | None = None) -> Column:
    """Seconds as text."""
    return strftime_parts(*parts_of(seconds), fmt, zone)


def strftime_parts(whole: Column, nanos: Column, fmt: str, zone: str | None = None) -> Column:
    below = F.lpad(nanos.cast("string"), 9, "0")  # digits of the fraction
    utc = F.timestamp_seconds(whole)
    at = F.from_utc_timestamp(utc, zone) if zone else utc
    out: list[Column | str] = []  # columns, and JVM patterns: those that follow each other are one, as each writes out the time again

    def code(p: str) -> None:
        if out and isinstance(out[-1], str) and out[-1][-1] != p[0]:
            out[-1] += p
        else:
            out.append(p)

    for kind, x in _pattern_parts(fmt):
        if kind == "text":
            code("'" + x.replace("'", "''") + "'")
        elif kind == "frac":
            code("ss")
            out.append(F.concat(F.lit("."), F.substring(below, 1, x)))
        elif x == "s":
            out.append(whole.cast("string"))
        elif x == "N":
            out.append(below)
        elif x == "n":
            code("'\n'")
        elif x == "Z":
            out.append(zone_name(utc, zone))
        elif x == "z":
            out.append(zone_offset(offset_of(utc, zone)))
        elif x in STRFTIME:
            code(STRFTIME[x])
        else:
            raise ValueError(f"no time format %{x}")
    shown = [F.date_format(at, x) if isinstance(x, str) else x for x in out]
    return F.when(whole.isNotNull(), F.concat(*shown) if len(shown) > 1 else shown[0])


def strptime_micros(text: Column, fmt: str, zone: str | None = None) -> Column:
    """Microseconds of a time; what does not parse is NULL."""
    if fmt == "%s":
        return (text_double(text).cast("decimal(38,9)") * 1000000).cast("bigint")
    pattern = ""
    for kind, x in _pattern_parts(fmt):
        if kind == "text":
            pattern += x if not re.search(r"[A-Za-z#{}\[\]']", x) else "'" + x.replace("'", "''") + "'"
        elif kind == "frac":
            pattern += "ss." + "S" * x
        elif x in STRFTIME:
            pattern += STRFTIME[x]
        else:
            raise ValueError(f"no time format %{x}")
    at = F.try_to_timestamp(text, F.lit(pattern))
    if fmt.endswith("S"):
        at = F.coalesce(at, F.try_to_timestamp(text, F.lit(pattern + ".[SSSSSSSSS][SSSSSS][SSS][SS][S]"))) if not re.search(r"%\dS", fmt) else at
    if zone:
        at = F.to_utc_timestamp(at, zone)
    return F.unix_micros(at)


def strptime(text: Column, fmt: str, zone: str | None = None) -> Val:
    """Seconds: whole ones where the format leaves no place for a fraction."""
    micros = strptime_micros(text, fmt, zone)
    if fmt != "%s" and not fmt.endswith("S") and not re.search(r"%\dS", fmt):
        return I(F.floor(micros / F.lit(1000000)))
    return D(micros / F.lit(1e6))


def gmt2sec(text: Column, zone: str | None = None) -> Column:
    """Lenient ISO times."""
    t = F.translate(F.trim(text), "Tt", "  ")
    whole = t.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}(?: \d{1,2}(?::\d{1,2}(?::\d{1,2})?)?)?[Zz]?(?:\r\n|[\n\r\u0085\u2028\u2029])?\z")
    at = F.try_to_timestamp(F.when(whole, F.rtrim(t, F.lit("Zz\r\n\u0085\u2028\u2029"))), F.lit("y-M-d[ H[:m[:s]]]"))
    return F.unix_timestamp(F.to_utc_timestamp(at, zone) if zone else at)


def sec_or(v: Val, shown: Column) -> Val:
    """A number's text, or what is no number as it is."""
    return S(F.coalesce(F.when(num(v).isNotNull(), shown), txt(v)))


def _zone(v: Val | None) -> str:
    return v.literal if v is not None else os.environ.get("TZ", "UTC") or "UTC"


def _local(v: Val, unit: int, decimals: Val | None, zone: Val | None) -> Val:
    d = int(decimals.literal) if decimals is not None else 0
    s = num(v).cast("decimal(38,9)") / unit
    return sec_or(v, strftime(s, "%Y-%m-%d %H:%M:%S" if not d else f"%Y-%m-%d %H:%M:%{d}S", _zone(zone)))


def _sec2local(unit: int) -> Callable:
    def run(v: Val, a: Val | None = None, b: Val | None = None) -> Val:
        if b is not None:
            return _local(v, unit, a, b)
        if a is not None and a.kind == "int":
            return _local(v, unit, a, None)
        return _local(v, unit, None, a)

    return run


def _sec2gmt(unit: int) -> Callable:
    return lambda v, d=None: sec_or(v, gmt(num(v).cast("decimal(38,9)") / unit, int(d.literal) if d is not None else 0))


def _dhms(text: Column) -> Column:
    """1d2h3m4s as seconds; a sign in front counts for all."""
    get = lambda u, n="\\d+": F.coalesce(F.regexp_extract(text, rf"({n}){u}", 1).try_cast("double"), F.lit(0.0))
    total = get("d") * 86400 + get("h") * 3600 + get("m") * 60 + get("s", r"\d+\.?\d*")
    return F.when(text.rlike(r"^-?(\d+d)?(\d+h)?(\d+m)?(\d+\.?\d*s)?$") & (text != ""), F.when(text.startswith("-"), -total).otherwise(total))


def sec2dhms(s: Column) -> Column:
    s = s.cast("bigint")
    d, h, m, r = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    t = lambda x: x.cast("string")
    return (
        F.when(d > 0, F.concat(t(d), F.lit("d"), two(h), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s")))
        .when(h > 0, F.concat(t(h), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s"))).when(m > 0, F.concat(t(m), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(t(r), F.lit("s")))
    )


def fsec2dhms(s: Column) -> Column:
    a = F.abs(s)
    whole = F.floor(a)
    sign = F.when(s < 0, F.lit(-1)).otherwise(F.lit(1))
    d, h, m = F.floor(whole / 86400), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60
    r = a - F.floor(a / 60) * 60
    return (
        F.when(d > 0, F.format_string("%dd%02dh%02dm%09.6fs", d * sign, h, m, r)).when(h > 0, F.format_string("%dh%02dm%09.6fs", h * sign, m, r))
        .when(m > 0, F.format_string("%dm%09.6fs", m * sign, r)).otherwise(F.format_string("%.6fs", r * sign))
    )


def sec2hms(s: Column) -> Column:
    s = s.cast("bigint")
    a = F.abs(s)
    body = F.format_string("%02d:%02d:%02d", F.floor(a / 3600), F.floor(a / 60) % 60, a % 60)
    return F.when(s < 0, F.concat(F.lit("-"), body)).otherwise(body)


def fsec2hms(s: Column) -> Column:
    a = F.abs(s)
    micros = F.round(a * 1000000).cast("bigint")
    whole = F.floor(micros / 1000000)
    body = F.format_string("%02d:%02d:%02d.%06d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, micros % 1000000)
    return F.when(s < 0, F.concat(F.lit("-"), body)).otherwise(body)


def hms(text: Column) -> Column:
    bare = F.regexp_replace(text, "^-", "")
    parts = F.split(bare, ":")
    n = F.size(parts)
    total = F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda s, x: s * 60 + x)
    return F.when(bare.rlike(r"^\d+(:\d+){0,2}(\.\d+)?$") & (n <= 3), F.when(text.startswith("-"), -total).otherwise(total))


def datediff(a: Val, b: Val, unit: Val) -> Val:
    """Whole calendar units from the first date to the second."""
    x, y = (F.to_date(F.timestamp_seconds(num(v)) if v.numeric else F.timestamp_seconds(gmt2sec(txt(v)))) for v in (a, b))
    swap = y < x
    lo, hi = F.least(x, y), F.greatest(x, y)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - (F.dayofmonth(hi) < F.dayofmonth(lo)).cast("int")
    years = F.floor(months / 12)
    u = unit.literal
    if u == "d":
        out = F.datediff(hi, lo)
    elif u == "m":
        out = months
    elif u == "y":
        out = years
    elif u == "ym":
        out = months % 12
    elif u == "yd":
        out = F.datediff(hi, F.add_months(lo, (years * 12).cast("int")))
    elif u == "md":
        out = F.datediff(hi, F.add_months(lo, months.cast("int")))
    else:
        raise ValueError(f"datediff: no unit {u}")
    return I(F.when(swap, -out).otherwise(out))


# ---------------------------------------------------------------- types


def is_int(v: Val) -> Column:
    if v.kind == "int":
        return v.c.isNotNull()
    return F.coalesce(text_long(v.c).isNotNull(), F.lit(False)) if v.kind == "any" else F.lit(False)


def is_float(v: Val) -> Column:
    if v.kind == "float":
        return v.c.isNotNull()
    return F.coalesce(text_double(v.c).isNotNull() & text_long(v.c).isNull(), F.lit(False)) if v.kind == "any" else F.lit(False)


def is_string(v: Val) -> Column:
    if v.kind == "str":
        return v.c.isNotNull()
    return F.coalesce(v.c.isNotNull() & text_double(v.c).isNull(), F.lit(False)) if v.kind == "any" else F.lit(False)


def _kind_test(*kinds: str) -> Callable:
    return lambda v: v.c.isNotNull() if v.kind in kinds else F.lit(False)


TESTS: dict[str, Callable[[Val], Column]] = {
    "absent": lambda v: v.c.isNull(), "array": _kind_test("array"), "bool": _kind_test("bool"), "boolean": _kind_test("bool"), "bytes": _kind_test("bytes"), "empty": empty,
    "empty_map": lambda v: F.coalesce(F.size(as_map(v)) == 0, F.lit(False)) if v.kind == "map" else F.lit(False), "error": lambda v: F.lit(False), "float": is_float, "int": is_int, "map": _kind_test("map"),
    "nonempty_map": lambda v: F.coalesce(F.size(as_map(v)) > 0, F.lit(False)) if v.kind == "map" else F.lit(False), "not_empty": lambda v: v.c.isNotNull() & ~empty(v), "not_map": lambda v: ~_kind_test("map")(v),
    "not_array": lambda v: ~_kind_test("array")(v), "not_null": lambda v: v.c.isNotNull() & ~empty(v), "null": lambda v: v.c.isNull() | empty(v), "numeric": lambda v: is_int(v) | is_float(v),
    "present": lambda v: v.c.isNotNull(), "string": is_string, "nan": lambda v: F.coalesce(F.isnan(dbl(v)), F.lit(False)),
}


def typeof(v: Val) -> Val:
    name = {"bool": "boolean", "map": "map", "array": "array", "bytes": "bytes", "time": "string"}.get(v.kind)
    if v.kind == "absent":
        return S(F.lit("absent"))
    if name:
        return S(F.when(v.c.isNull(), "absent").otherwise(name))
    return S(F.when(v.c.isNull(), "absent").when(empty(v), "empty").when(is_int(v), "int").when(is_float(v), "float").otherwise("string"))


def asserting(name: str) -> Callable:
    def run(v: Val) -> Val:
        c = F.when(TESTS[name](v), v.c).otherwise(F.raise_error(F.lit(f"is_{name} does not hold")).cast(v.type or {"int": "bigint", "float": "double", "bool": "boolean"}.get(v.kind, "string")))
        return dataclasses.replace(v, c=c)

    return run


def to_int(a: Val, base: Val | None = None) -> Val:
    if a.numeric:
        return I(a.c)
    if base is not None:
        return I(F.conv(F.regexp_replace(txt(a), "^0[xXbBo]", ""), int(base.literal), 10).try_cast("bigint"))
    c = txt(a)
    octal = F.when(c.rlike("^-?0[0-7]+$"), F.conv(c, 8, -10).try_cast("bigint"))
    return I(F.coalesce(octal, text_long(c), text_double(c).try_cast("bigint")))


def _random(seed=None) -> Column:
    return F.rand(seed)


#: name -> (fewest arguments, most arguments, builder)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Val]]] = {}


def _add(names: str, low: int, high: int, f: Callable) -> None:
    for n in names.split():
        FUNCTIONS[n] = (low, high, f)


MANY = 99
_add("+", 1, 2, lambda a, b=None: plus(a, b) if b is not None else positive(a))
_add("-", 1, 2, lambda a, b=None: minus(a, b) if b is not None else negate(a))
_add("*", 2, 2, times)
_add("/", 2, 2, divide)
_add("//", 2, 2, floor_divide)
_add("** pow", 2, 2, power)
_add(".+", 2, 2, _wrap("+"))
_add(".-", 2, 2, _wrap("-"))
_add(".*", 2, 2, _wrap("*"))
_add("./", 2, 2, lambda a, b: I(F.call_function("try_divide", dbl(a), dbl(b)).cast("bigint")))
_add("%", 2, 2, modulus)
_add("~", 1, 1, lambda a: I(F.bitwise_not(lng(a))))
_add("&", 2, 2, _bits(lambda x, y: x.bitwiseAND(y)))
_add("|", 2, 2, _bits(lambda x, y: x.bitwiseOR(y)))
_add("^", 2, 2, _bits(lambda x, y: x.bitwiseXOR(y)))
_add("<<", 2, 2, _shift("shiftleft"))
_add(">>", 2, 2, _shift("shiftright"))
_add(">>>", 2, 2, _shift("shiftrightunsigned"))
_add("bitcount", 1, 1, lambda a: I(F.bit_count(lng(a))))
_add("madd", 3, 3, _modular("+"))
_add("msub", 3, 3, _modular("-"))
_add("mmul", 3, 3, _modular("*"))
_add("mexp", 3, 3, lambda a, b, m: I(_mexp(lng(a), lng(b), lng(m))))
_add("!", 1, 1, lambda a: B(~boolean(a)))
for _op in ("==", "!=", "<", "<=", ">", ">="):
    _add(_op, 2, 2, _compare(_op))
_add("<=>", 2, 2, spaceship)
for _op in ("&&", "||", "^^"):
    _add(_op, 2, 2, _logic(_op))
_add("??", 2, 2, absent_or)
_add("???", 2, 2, absent_empty_or)
_add("?:", 3, 3, ternary)
_add("=~ strmatch", 2, 2, lambda a, p: B(txt(a).rlike(_pattern(p))))
_add("!=~", 2, 2, lambda a, p: B(~txt(a).rlike(_pattern(p))))
_add("strmatchx", 2, 2, strmatchx)
_add(".", 2, 2, dot)
_add("base64_decode", 1, 1, lambda a: Val(F.unbase64(txt(a)), "bytes"))
_add("base64_encode", 1, 1, lambda a: S(F.regexp_replace(F.base64(a.c if a.kind == "bytes" else F.encode(txt(a), "UTF-8")), "[\r\n]", "")))
_add("hex_decode", 1, 1, lambda a: Val(F.unhex(txt(a)), "bytes"))
_add("hex_encode", 1, 1, lambda a: S(F.lower(F.hex(a.c if a.kind == "bytes" else F.encode(txt(a), "UTF-8")))))
_add("capitalize", 1, 1, lambda a: S(F.concat(F.upper(F.substring(txt(a), 1, 1)), F.substring(txt(a), F.lit(2), F.char_length(txt(a))))))
_add("clean_whitespace", 1, 1, lambda a: Val(clean(txt(a)), "any"))
_add("collapse_whitespace", 1, 1, lambda a: S(F.regexp_replace(txt(a), r"\s+", " ")))
_add("lstrip", 1, 1, lambda a: S(F.regexp_replace(txt(a), r"^[ \t]+", "")))
_add("rstrip", 1, 1, lambda a: S(F.regexp_replace(txt(a), r"[ \t]+$", "")))
_add("strip", 1, 1, lambda a: S(F.regexp_replace(txt(a), r"^[ \t]+|[ \t]+$", "")))
_add("regextract", 2, 2, lambda a, p: S(F.regexp_substr(txt(a), F.lit(_pattern(p)))))
_add("regextract_or_else", 3, 3, lambda a, p, d: S(F.coalesce(F.regexp_substr(txt(a), F.lit(_pattern(p))), txt(d))))
_add("strlen", 1, 1, lambda a: I(F.octet_length(a.c) if a.kind == "bytes" else F.char_length(txt(a))))
_add("ssub", 3, 3, _sub(ssub_first))
_add("gssub", 3, 3, lambda a, o, n: S(F.replace(txt(a), txt(o), txt(n))))
_add("sub", 3, 3, _sub(sub_first))
_add("gsub", 3, 3, _sub(_gsub))
_add("substr0 substr", 3, 3, substr0)
_add("substr1", 3, 3, substr1)
_add("index", 2, 2, lambda a, b: I(F.when(F.position(txt(b), txt(a)) == 0, -1).otherwise(F.position(txt(b), txt(a)))))
_add("contains", 2, 2, lambda a, b: B(txt(a).contains(txt(b))))
_add("tolower", 1, 1, lambda a: S(F.lower(txt(a))))
_add("toupper", 1, 1, lambda a: S(F.upper(txt(a))))
_add("truncate", 2, 2, lambda a, n: S(F.left(txt(a), lng(n).cast("int"))))
_add("leftpad", 3, 3, _pad(True))
_add("rightpad", 3, 3, _pad(False))
_add("format", 1, MANY, format_text)
_add("unformat", 2, 2, _unformat(True))
_add("unformatx", 2, 2, _unformat(False))
_add("latin1_to_utf8", 1, 1, lambda a: S(F.decode(a.c if a.kind == "bytes" else F.encode(txt(a), "UTF-8"), "ISO-8859-1")))
_add("utf8_to_latin1", 1, 1, lambda a: Val(F.encode(txt(a), "ISO-8859-1"), "bytes"))
_add("md5", 1, 1, lambda a: S(F.md5(txt(a))))
_add("sha1", 1, 1, lambda a: S(F.sha1(txt(a))))
_add("sha256", 1, 1, lambda a: S(F.sha2(txt(a), 256)))
_add("sha512", 1, 1, lambda a: S(F.sha2(txt(a), 512)))
_add("crc32", 1, 1, lambda a: I(F.crc32(F.encode(txt(a), "UTF-8"))))
_add("abs", 1, 1, _same_kind(F.abs, F.abs))
_add("ceil ceiling", 1, 1, _same_kind(lambda c: c, F.ceil))
_add("floor", 1, 1, _same_kind(lambda c: c, F.floor))
_add("round", 1, 1, _same_kind(lambda c: c, _round))
_add("sgn", 1, 1, _same_kind(F.signum, F.signum))
for _n in ("acos", "acosh", "asin", "asinh", "atan", "atanh", "cbrt", "cos", "cosh", "exp", "expm1", "log10", "log1p", "sin", "sinh", "sqrt", "tan", "tanh"):
    _add(_n, 1, 1, _d1(getattr(F, _n)))
_add("log", 1, 1, _d1(F.ln))
_add("atan2", 2, 2, lambda a, b: D(F.atan2(dbl(a), dbl(b))))
_add("erf", 1, 1, _d1(_erf))
_add("erfc", 1, 1, _d1(_erfc))
_add("qnorm", 1, 1, lambda a: D(0.5 * _erfc(-dbl(a) / math.sqrt(2))))
_add("invqnorm", 1, 1, _d1(_invqnorm))
_add("logifit", 3, 3, lambda x, m, b: D(1 / (1 + F.exp(-dbl(m) * dbl(x) - dbl(b)))))
_add("exec system", 1, MANY, lambda *a: _refuse("shell commands do not run on a cluster"))
_add("max", 0, MANY, _extreme(True))
_add("min", 0, MANY, _extreme(False))
_add("roundm", 2, 2, roundm)
_add("urand", 0, 0, lambda: D(_random()))
_add("urandint", 2, 2, lambda a, b: I(F.floor(lng(a) + (lng(b) - lng(a) + 1) * _random())))
_add("urandrange", 2, 2, lambda a, b: D(dbl(a) + (dbl(b) - dbl(a)) * _random()))
_add("urand32", 0, 0, lambda: I(F.floor(_random() * float(2**32))))
_add("urandelement", 1, 1, lambda v: Val(F.element_at(v.c, (F.floor(_random() * F.size(v.c)) + 1).cast("int")), element_kind(v)))
_add("count", 1, 1, lambda v: I(F.size(elements(v))))
_add("null_count", 1, 1, lambda v: I(F.size(F.filter(elements(v), lambda x: x.isNull() | (x.cast("string") == "")))))
for _n in ("distinct_count", "mode", "antimode", "mean", "meaneb", "stddev", "skewness", "kurtosis", "minlen", "maxlen"):
    _add(_n, 1, 1, _stat(_n))
_add("variance var", 1, 1, _stat("var"))
_add("sum", 1, 1, lambda v: I(F.aggregate(elements(v), F.lit(0).cast("bigint"), lambda s, x: s + x)) if element_kind(v) == "int" else _stat("sum")(v))
for _k in (2, 3, 4):
    _add(f"sum{_k}", 1, 1, _power_sum(_k))
_add("median", 1, 2, lambda v, o=None: percentile(v, lit(50), o))
_add("percentile", 2, 3, percentile)
_add("percentiles", 2, 3, percentiles)
_add("sort_collection", 1, 1, lambda v: sort_by_flags(Val(elements(v), "array", T.ArrayType(T.StringType() if element_kind(v) == "any" else T.DoubleType()))))
_add("sparkline", 1, 1, lambda v: S(ticks(numbers(v).cast("array<double>"))))
_add("datediff", 3, 3, datediff)
_add("gmt2sec", 1, 1, lambda a: I(gmt2sec(txt(a))))
_add("gmt2nsec", 1, 1, lambda a: I(gmt2sec(txt(a)) * 1000000000))
_add("localtime2sec", 1, 2, lambda a, z=None: I(gmt2sec(txt(a), _zone(z))))
_add("localtime2nsec", 1, 2, lambda a, z=None: I(gmt2sec(txt(a), _zone(z)) * 1000000000))
_add("sec2gmt", 1, 2, _sec2gmt(1))
_add("nsec2gmt", 1, 2, _sec2gmt(10**9))
_add("sec2localtime", 1, 3, _sec2local(1))
_add("nsec2localtime", 1, 3, _sec2local(10**9))
_add("sec2gmtdate", 1, 1, lambda v: sec_or(v, strftime(num(v), "%Y-%m-%d")))
_add("nsec2gmtdate", 1, 1, lambda v: sec_or(v, strftime(num(v).cast("decimal(38,9)") / 10**9, "%Y-%m-%d")))
_add("sec2localdate", 1, 2, lambda v, z=None: sec_or(v, strftime(num(v), "%Y-%m-%d", _zone(z))))
_add("nsec2localdate", 1, 2, lambda v, z=None: sec_or(v, strftime(num(v).cast("decimal(38,9)") / 10**9, "%Y-%m-%d", _zone(z))))
_add("localtime2gmt", 1, 2, lambda a, z=None: S(gmt(gmt2sec(txt(a), _zone(z)))))
_add("gmt2localtime", 1, 2, lambda a, z=None: S(strftime(gmt2sec(txt(a)), "%Y-%m-%d %H:%M:%S", _zone(z))))
_add("strftime", 2, 2, lambda a, f: S(strftime(num(a), f.literal)))
_add("strfntime", 2, 2, lambda a, f: S(strftime_parts(*parts_of_nanos(lng(a)), f.literal)))
_add("strftime_local", 2, 3, lambda a, f, z=None: S(strftime(num(a), f.literal, _zone(z))))
_add("strfntime_local", 2, 3, lambda a, f, z=None: S(strftime_parts(*parts_of_nanos(lng(a)), f.literal, _zone(z))))
_add("strptime", 2, 2, lambda a, f: strptime(txt(a), f.literal))
_add("strpntime", 2, 2, lambda a, f: I(strptime_micros(txt(a), f.literal) * 1000))
_add("strptime_local", 2, 3, lambda a, f, z=None: strptime(txt(a), f.literal, _zone(z)))
_add("strpntime_local", 2, 3, lambda a, f, z=None: I(strptime_micros(txt(a), f.literal, _zone(z)) * 1000))
_add("dhms2fsec", 1, 1, lambda a: D(_dhms(txt(a))))
_add("dhms2sec", 1, 1, lambda a: I(_dhms(txt(a))))
_add("sec2dhms", 1, 1, lambda a: S(sec2dhms(num(a))))
_add("fsec2dhms", 1, 1, lambda a: S(fsec2dhms(dbl(a))))
_add("sec2hms", 1, 1, lambda a: S(sec2hms(num(a))))
_add("fsec2hms", 1, 1, lambda a: S(fsec2hms(dbl(a))))
_add("hms2sec", 1, 1, lambda a: I(hms(txt(a))))
_add("hms2fsec", 1, 1, lambda a: D(hms(txt(a))))
_add("systime", 0, 0, lambda: D(F.unix_micros(F.current_timestamp()) / 1e6))
_add("sysntime", 0, 0, lambda: I(F.unix_micros(F.current_timestamp()) * 1000))
_add("systimeint", 0, 0, lambda: I(F.unix_micros(F.current_timestamp()) / 1000000))
_add("uptime", 0, 0, lambda: D(F.lit(time.time() - STARTED)))
_add("upntime", 0, 0, lambda: I(F.lit(int((time.time() - STARTED) * 1e9))))
for _n, _t in TESTS.items():
    _add(f"is_{_n}", 1, 1, (lambda t: lambda v: B(t(v)))(_t))
    if _n != "nan":
        _add(f"asserting_{_n}", 1, 1, asserting(_n))
_add("typeof", 1, 1, typeof)
_add("boolean", 1, 1, lambda a: B(boolean(a) if not a.numeric else a.c != 0))
_add("bytes", 1, 1, lambda a: Val(F.encode(txt(a), "UTF-8"), "bytes"))
_add("float", 1, 1, lambda a: D(dbl(a)))
_add("fmtnum", 2, 2, fmtnum)
_add("fmtifnum", 2, 2, fmtifnum)
_add("hexfmt", 1, 1, lambda a: S(F.concat(F.lit("0x"), F.lower(F.hex(lng(a))))))
_add("int", 1, 2, to_int)
_add("string", 1, 1, lambda a: S(txt(a)))
_add("joink", 2, 2, lambda m, s: S(F.array_join(F.map_keys(as_map(m)), s.literal)))
_add("joinv", 2, 2, lambda m, s: S(F.array_join(F.transform(elements(m), lambda x: x.cast("string")), s.literal)))
_add("joinkv", 3, 3, lambda m, p, s: S(F.array_join(F.transform(F.map_entries(as_map(m)), lambda e: F.concat(e["key"], F.lit(p.literal), e["value"].cast("string"))), s.literal)))
_add("splita splitax", 2, 2, lambda a, s: Val(splitter(a, s), "array", STRINGS))
_add("splitkv splitkvx", 3, 3, _splitkv)
_add("splitnv splitnvx", 2, 2, _splitnv)
_add("append", 2, 2, lambda v, x: Val(F.array_append(v.c, txt(x) if element_kind(v) == "any" else x.c), "array", v.type))
_add("arrayify", 1, 1, lambda v: Val(F.map_values(as_map(v)), "array", T.ArrayType(_map_type(v).valueType)) if v.kind == "map" else v)
_add("concat", 0, MANY, concat_arrays)
_add("depth", 1, 1, lambda v: lit(_depth(v.type)))
_add("get_keys", 1, 1, lambda v: Val(F.map_keys(as_map(v)), "array", STRINGS) if v.kind == "map" else Val(F.transform(v.c, lambda x, i: (i + 1).cast("bigint")), "array", T.ArrayType(T.LongType())))
_add("get_values", 1, 1, lambda v: Val(elements(v), "array", T.ArrayType(_map_type(v).valueType) if v.kind == "map" else v.type))
_add("haskey", 2, 2, haskey)
_add("hasvalue", 2, 2, lambda v, x: B(F.exists(elements(v), lambda y: y.cast("string") == txt(x))))
_add("json_parse json_decode", 1, 1, lambda a: Val(F.try_parse_json(txt(a)), "any", T.VariantType()))
_add("json_stringify json_encode", 1, 2, lambda a, _=None: json_text(a))
_add("leafcount", 1, 1, leafcount)
_add("length", 1, 1, length)
_add("mapdiff", 1, MANY, mapdiff)
_add("mapexcept", 1, MANY, lambda m, *ks: Val(F.map_filter(as_map(m), (lambda names: lambda k, v: ~k.isin(names))(_keys_of(ks))), "map", _map_type(m)))
_add("mapselect", 1, MANY, lambda m, *ks: Val(F.map_filter(as_map(m), (lambda names: lambda k, v: k.isin(names))(_keys_of(ks))), "map", _map_type(m)))
_add("mapsum", 0, MANY, mapsum)
_add("hostname", 0, 0, lambda: lit(socket.gethostname()))
_add("os", 0, 0, lambda: lit(platform.system().lower()))
_add("version", 0, 0, lambda: lit("0.1"))


def _flat(v: Val, name: str, sep: str) -> Val:
    """A nested value as a map of texts by its paths; only what the schema tells."""
    from ..operators.reshape import _leaves

    if isinstance(v.type, T.MapType) and not _depth(v.type.valueType):
        return Val(F.transform_keys(v.c, lambda k, x: F.concat(F.lit(name + sep), k) if name else k), "map", v.type)
    if isinstance(v.type, T.MapType) and isinstance(v.type.valueType, T.MapType):  # the inner keys behind the outer ones; an inner map without any stays as {}
        inner = F.transform(F.map_entries(v.c), lambda e: F.when(F.size(e["value"]) == 0, F.array(F.struct(e["key"].alias("k"), F.lit("{}").alias("v")))).otherwise(
            F.transform(F.map_entries(_flat(Val(e["value"], "map", v.type.valueType), "", sep).c), lambda x: F.struct(F.concat(e["key"], F.lit(sep), x["key"]).alias("k"), x["value"].cast("string").alias("v")))))
        return _flat(Val(F.map_from_entries(F.flatten(inner)), "map", TEXT_MAP), name, sep)
    pairs = list(_leaves(v.c, v.type, name, sep, {}))
    return Val(F.create_map(*[x for c, n in pairs for x in (F.lit(n), c.cast("string"))]), "map", TEXT_MAP)


_add("flatten", 2, 3, lambda a, b, c=None: _flat(c, a.literal, b.literal) if c is not None else _flat(a, "", b.literal))
_add("unflatten", 2, 2, lambda m, s: m)


def stat(path: Val) -> Val:
    """What the driver's file system tells of a path."""
    st = os.stat(path.literal)
    pairs = {"name": path.literal, "size": str(st.st_size), "mode": oct(st.st_mode & 0o7777), "modtime": str(int(st.st_mtime)), "isdir": str(os.path.isdir(path.literal)).lower()}
    return Val(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), "map", TEXT_MAP)


_add("stat", 1, 1, stat)
_add("next", 0, 0, lambda: _refuse("next steps through records one after the other: a script's loop is the stream itself"))


def _refuse(why: str):
    raise ValueError(why)


def call(name: str, *args: Val) -> Val:
    if name not in FUNCTIONS:
        raise ValueError(f"no function {name}")
    low, high, f = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise ValueError(f"{name} takes {low} to {high} arguments, not {len(args)}")
    return f(*args)


__all__ = ["FUNCTIONS", "Val", "call", "kind_of", "lit", "sentence"]
