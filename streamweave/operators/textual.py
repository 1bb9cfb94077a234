"""Verbs that change the text of names and values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import Stream, col, is_text, java_regex, java_replacement, matcher, number
from .projection import renamed
from .registry import verb


def _chosen(s: Stream, f, r, a) -> list[str]:
    """Text fields that are named, that match, or all."""
    if a:
        names = s.columns
    elif r is not None:
        ms = [matcher(p) for p in (r if isinstance(r, list) else [r])]
        names = [c for c in s.columns if any(m.search(c) for m in ms)]
    else:
        names = [c for c in f or () if c in s.columns]
    return [c for c in names if is_text(s, c)]


def _not_number(s: Stream, c: str, new: Column) -> Column:
    """Only what is typed text is rewritten; numbers pass."""
    return F.when(number(s, c).isNotNull(), col(c)).otherwise(new)


def sub_first(c: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced: what stands before it, the replaced match, what stands behind."""
    regex = java_regex(pattern)
    at = F.regexp_instr(c, F.lit(regex))
    hit = F.regexp_substr(c, F.lit(regex))
    put = F.regexp_replace(hit, regex, java_replacement(replacement)) if not _looks_around(regex) else None
    if put is None:
        return F.regexp_replace(c, f"(?s)^(.*?)(?:{regex})", "$1" + re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", java_replacement(replacement)))
    rest = F.substring(c, at + F.char_length(hit), F.char_length(c))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), put, rest)).otherwise(c)


def _looks_around(regex: str) -> bool:
    return bool(re.search(r"\^|\$|\\b|\\B|\(\?[=!<]", regex))


def ssub_first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.char_length(c)))).otherwise(c)


def _subs(s: Stream, args, f, r, a, how) -> Stream:
    old, new = args
    return s.with_columns({c: _not_number(s, c, how(col(c), old, new)) for c in _chosen(s, f, r, a)})


_FLAGS = "-f=f:list -r=r:list -a=a:true"


@verb("sub", _FLAGS, "args")
def sub(s: Stream, args, f=None, r=None, a=False) -> Stream:
    """The first match of a regex replaced; ``args``: regex and replacement."""
    return _subs(s, args, f, r, a, sub_first)


@verb("gsub", _FLAGS, "args")
def gsub(s: Stream, args, f=None, r=None, a=False) -> Stream:
    """All matches of a regex replaced."""
    return _subs(s, args, f, r, a, lambda c, old, new: F.regexp_replace(c, java_regex(old), java_replacement(new)))


@verb("ssub", _FLAGS, "args")
def ssub(s: Stream, args, f=None, r=None, a=False) -> Stream:
    """The first occurrence of a text replaced."""
    return _subs(s, args, f, r, a, ssub_first)


def sentence(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.char_length(c))))


def title(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), sentence), " ")


@verb("case", "-k=keys:true -v=values:true -f=f:list -u=how:is-u -l=how:is-l -s=how:is-s -t=how:is-t")
def case(s: Stream, how=None, keys=False, values=False, f=None) -> Stream:
    """Upper, lower, sentence or title case of names (``keys`` only), of values (``values`` only), or of both."""
    change = {"u": F.upper, "l": F.lower, "s": sentence, "t": title}[how]
    word = {
        "u": str.upper, "l": str.lower, "s": lambda x: x[:1].upper() + x[1:].lower(), "t": lambda x: " ".join(w[:1].upper() + w[1:].lower() for w in x.split(" ")),
    }[how]
    names = [c for c in s.columns if not f or c in f]
    if not keys:
        s = s.with_columns({c: change(col(c)) for c in names if is_text(s, c)})
    return s if values else renamed(s, {c: word(c) for c in names})


def clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


@verb("clean-whitespace", "-k|--keys-only=keys:true -v|--values-only=values:true")
def clean_whitespace(s: Stream, keys=False, values=False) -> Stream:
    """White space at the ends goes, inside it becomes one blank; in names and values."""
    if not keys:
        s = s.with_columns({c: clean(col(c)) for c in s.columns if is_text(s, c)})
    return s if values else renamed(s, {c: re.sub(r"\s+", " ", c).strip() for c in s.columns})


@verb("unspace", "-f=filler:str -k=keys:true -v=values:true")
def unspace(s: Stream, filler="_", keys=False, values=False) -> Stream:
    """Blanks become the filler, in names and values."""
    if not keys:
        s = s.with_columns({c: F.replace(col(c), F.lit(" "), F.lit(filler)) for c in s.columns if is_text(s, c)})
    return s if values else renamed(s, {c: c.replace(" ", filler) for c in s.columns})


@verb("utf8-to-latin1")
def utf8_to_latin1(s: Stream) -> Stream:
    """Values as Latin-1 bytes where they can be written so."""
    return s.with_columns({c: F.encode(col(c), "ISO-8859-1") for c in s.columns if is_text(s, c)})


@verb("latin1-to-utf8")
def latin1_to_utf8(s: Stream) -> Stream:
    """Latin-1 bytes as text."""
    new = {}
    for c in s.columns:
        if isinstance(s.dtype(c), T.BinaryType):
            new[c] = F.decode(col(c), "ISO-8859-1")
        elif is_text(s, c):
            new[c] = F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")
    return s.with_columns(new)


def formatted(c: Column, fmt: str, integral: bool) -> Column:
    """printf of a number: integer formats of a float round toward zero, float formats of an integer widen it."""
    m = re.search(r"%([-+ 0#'_]*)(\d*)(\.\d+)?(?:l|ll|h)*([a-zA-Z])", fmt)
    if not m:
        return F.lit(fmt) if c is not None else c
    flags, width, places, kind = m[1].replace("'", ",").replace("_", ","), m[2], m[3] or "", m[4]
    head, tail = fmt[: m.start()], fmt[m.end() :]
    if kind in "dxXo":
        body = f"%{flags}{width}{kind}"
        if integral or kind != "d":
            v = c.cast("bigint")
        else:
            v = c.cast("bigint")
    elif kind in "fFeEgG":
        body = f"%{flags}{width}{places}{'f' if kind in 'fF' else kind}"
        v = c.cast("double")
    elif kind == "s":
        body, v = f"%{flags}{width}{places}s", c.cast("string")
    elif kind == "b":
        v = F.bin(c.cast("bigint"))
        body = f"%{width}s"
        if "0" in flags and width:
            v, body = F.lpad(v, int(width), "0"), "%s"
    else:
        raise ValueError(f"no format %{kind}")
    return F.when(c.isNotNull(), F.format_string(head.replace("%%", "%%") + body + tail, v))


@verb("format-values", "-i=i:str -f=f:str -s=s_:str -n=n:true")
def format_values(s: Stream, i="%d", f="%f", s_="%s", n=False) -> Stream:
    """printf by type: integers, floats, texts; with ``n`` all numbers by the float format."""
    new = {}
    for c in s.columns:
        t = s.dtype(c)
        if isinstance(t, T.IntegralType):
            new[c] = formatted(col(c), f if n else i, True)
        elif isinstance(t, T.NumericType):
            new[c] = formatted(col(c), f, False)
        elif isinstance(t, T.StringType):
            from ..plans.stream import text_double, text_long

            whole, real = text_long(col(c)), text_double(col(c))
            new[c] = F.when(whole.isNotNull(), formatted(whole, f if n else i, True)).when(real.isNotNull(), formatted(real, f, False)).otherwise(F.format_string(s_, col(c)))
    return s.with_columns(new)


def gmt(seconds: Column, decimals: int = 0) -> Column:
    """Seconds since 1970 as ISO text in UTC; up to six decimals from the clock, more as zeros."""
    micros = F.floor(seconds.cast("decimal(30,9)") * 1000000).cast("bigint")
    whole = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    if not decimals:
        return F.concat(whole, F.lit("Z"))
    part = F.lpad(F.pmod(micros, F.lit(1000000)).cast("string"), 6, "0")
    return F.concat(whole, F.lit("."), F.substring(F.concat(part, F.lit("000")), 1, decimals), F.lit("Z"))


@verb("sec2gmt", "--millis=unit:is-1000 --micros=unit:is-1000000 --nanos=unit:is-1000000000", "names")
def sec2gmt(s: Stream, names, unit="1", decimals=0) -> Stream:
    """Numbers as ISO times in UTC; what is no number stays."""
    new = {}
    for c in names:
        if c in s.columns:
            v = number(s, c)
            shown = gmt(v.cast("decimal(30,9)") / int(unit), decimals)
            new[c] = F.coalesce(F.when(v.isNotNull(), shown), col(c).cast("string"))
    return s.with_columns(new)


@verb("sec2gmtdate", positional="names")
def sec2gmtdate(s: Stream, names) -> Stream:
    """Numbers as dates in UTC; what is no number stays."""
    new = {}
    for c in names:
        if c in s.columns:
            v = number(s, c)
            new[c] = F.coalesce(F.when(v.isNotNull(), F.date_format(F.timestamp_seconds(F.floor(v)), "yyyy-MM-dd")), col(c).cast("string"))
    return s.with_columns(new)


@verb("bar", "-f=f:list --lo=lo:float --hi=hi:float -w=w:int --auto=auto:true -c=fill:str -x=out:str -b=blank:str")
def bar(s: Stream, f=(), lo=0.0, hi=100.0, w=40, auto=False, fill="*", out="#", blank=".") -> Stream:
    """Numbers as bars of up to w signs; a value out of bounds is marked at that end."""
    new = {}
    if auto:
        got = s.df.agg(*[g for x in f for g in (F.min(number(s, x)), F.max(number(s, x)))]).first()
    for k, x in enumerate(f):
        v = number(s, x).cast("double")
        a, z = (float(got[2 * k] or 0), float(got[2 * k + 1] or 0)) if auto else (lo, hi)
        at = F.greatest(F.lit(0), F.least(F.lit(w), ((v - a) * (w / (z - a) if z > a else 0.0)).cast("int")))
        plain = F.concat(F.repeat(F.lit(fill), at), F.repeat(F.lit(blank), F.lit(w) - at))
        low = F.lit(out + blank * (w - 1))
        high = F.lit(fill * (w - 1) + out)
        new[x] = F.when(v < a, low).when(v > z, high).otherwise(plain)
    return s.with_columns(new)
