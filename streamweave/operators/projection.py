"""Verbs that choose, name and order fields."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import HIDDEN, Stream, col, matcher, nonempty
from ..plans.ordered import running
from .registry import verb


def _matching(s: Stream, patterns: list[str]) -> list[str]:
    ms = [matcher(p) for p in patterns]
    return [c for c in s.columns if any(m.search(c) for m in ms)]


@verb("cat", "-n=n:true -N=name:str -g=g:list --filename=filename:true --filenum=filenum:true")
def cat(s: Stream, n=False, name=None, g=(), filename=False, filenum=False) -> Stream:
    """All records; with a counter (of the group), file name and file number in front. Records that lack a group field are dropped."""
    front = {}
    if filenum:
        front["filenum"] = F.dense_rank().over(s.window().orderBy(F.input_file_name()))
    if filename:
        front["filename"] = F.input_file_name()
    if g:
        s = s.where(_all(s, g))
    if n or name:
        if g:
            front[name or "n"] = F.row_number().over(s.window(*g)).cast("bigint")
        else:
            s = running(s, {}, number="_number")
            front[name or "n"] = col("_number")
    if not front:
        return s
    return s.select([*[c.alias(k) for k, c in front.items()], *[c for c in s.columns if c not in front and c != "_number"]])


def _all(s: Stream, names):
    """All the named fields present; a field that no record has is not."""
    out = F.lit(True)
    for x in names:
        out = out & (col(x).isNotNull() if x in s.columns else F.lit(False))
    return out


@verb("cut", "-f=f:list -o=o:true -x|--complement=x:true -r=r:true")
def cut(s: Stream, f=(), o=False, x=False, r=False) -> Stream:
    """Keep fields, in their own order or (``o``) in the given one; or drop them (``x``); names or regexes (``r``)."""
    if r:
        chosen = [c for p in f for c in _matching(s, [p])] if o else _matching(s, f)
    else:
        chosen = [c for c in f if c in s.columns] if o else [c for c in s.columns if c in set(f)]
    chosen = list(dict.fromkeys(chosen))
    return s.select([c for c in s.columns if c not in chosen] if x else chosen)


@verb("having-fields", "--at-least=at_least:list --which-are=which_are:list --at-most=at_most:list --all-defined=all_defined:list --any-defined=any_defined:list --all-matching=all_matching:str --any-matching=any_matching:str --none-matching=none_matching:str")
def having_fields(s: Stream, at_least=None, which_are=None, at_most=None, all_defined=None, any_defined=None, all_matching=None, any_matching=None, none_matching=None) -> Stream:
    """Records by the set of fields they have (those that are not absent)."""

    def has(c):
        return col(c).isNotNull()

    def conj(cs):
        out = F.lit(True)
        for c in cs:
            out = out & c
        return out

    def disj(cs):
        out = F.lit(False)
        for c in cs:
            out = out | c
        return out

    cols = s.columns
    if at_least is not None:
        return s.where(_all(s, at_least))
    if which_are is not None:
        return s.where(_all(s, which_are) & conj(~has(c) for c in cols if c not in which_are))
    if at_most is not None:
        return s.where(conj(~has(c) for c in cols if c not in at_most))
    if all_defined is not None:
        return s.where(conj(nonempty(s, c) if c in cols else F.lit(False) for c in all_defined))
    if any_defined is not None:
        return s.where(disj(nonempty(s, c) for c in any_defined if c in cols))
    m = matcher(all_matching or any_matching or none_matching)
    hit = [c for c in cols if m.search(c)]
    miss = [c for c in cols if c not in hit]
    if all_matching is not None:
        return s.where(disj(has(c) for c in cols) & conj(~has(c) for c in miss))
    if any_matching is not None:
        return s.where(disj(has(c) for c in hit))
    return s.where(conj(~has(c) for c in hit))


def renamed(s: Stream, names: dict[str, str]) -> Stream:
    """Fields renamed in place; a field that had the new name goes."""
    names = {k: v for k, v in names.items() if k in s.columns and k != v}
    out: list[tuple[str, str]] = [(c, c) for c in s.columns]
    for old, new in names.items():
        out = [(src, c) for src, c in out if c != new]
        out = [(src, new if c == old else c) for src, c in out]
    return s.select([col(src).alias(c) for src, c in out])


@verb("label", positional="names")
def label(s: Stream, names) -> Stream:
    """New names for the first fields, by position; a later field of such a name goes."""
    if len(set(names)) < len(names):
        raise ValueError("label: names must differ")
    cols = s.columns
    new = list(names)[: len(cols)]
    return s.select([col(c).alias(n) for c, n in zip(cols, new)] + [c for c in cols[len(new) :] if c not in new])


@verb("rename", "-r=r:true -g=g:true", "names")
def rename(s: Stream, names, r=False, g=False) -> Stream:
    """Pairs of old and new names; with regexes (``r``), once per name or everywhere in it (``g``)."""
    if len(names) % 2:
        raise ValueError("rename: names come in pairs")
    pairs = list(zip(names[::2], names[1::2]))
    if not (r or g):
        for old, new in pairs:
            s = renamed(s, {old: new})
        return s
    for old, new in pairs:
        m = matcher(old)
        for c in s.columns:
            if m.search(c):
                s = renamed(s, {c: m.sub(re.sub(r"\\([0-9])", r"\\g<\1>", new), c, count=0 if g else 1)})
    return s


@verb("reorder", "-e=e:true -f=f:list -r=r:list -b=before:str -a=after:str")
def reorder(s: Stream, f=None, r=None, e=False, before=None, after=None) -> Stream:
    """Fields to the start (the last named first, as each is put there in turn), to the end, or beside a pivot."""
    cols = s.columns
    names = _matching(s, r) if r else [c for c in dict.fromkeys(f or ()) if c in cols]
    rest = [c for c in cols if c not in names]
    pivot = before or after
    if pivot is not None:
        if pivot not in cols or pivot in names:
            return s
        at = rest.index(pivot) + (after is not None)
        return s.select(rest[:at] + names + rest[at:])
    return s.select(rest + names if e else ([*reversed(names)] if not r else names) + rest)


@verb("regularize")
def regularize(s: Stream) -> Stream:
    """Records of one set of fields in one field order: so they are, as a DataFrame has one column order."""
    return s


@verb("sort-within-records", "-r=recursive:true -f=f:list -n=natural:true")
def sort_within_records(s: Stream, recursive=False, f=None, natural=False) -> Stream:
    """Fields in the order of their names; the named ones only (in front of the rest), nested ones too, or by natural order."""

    def key(c: str):
        return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", c)] if natural else c

    cols = s.columns
    order = sorted([c for c in cols if not f or c in f], key=key) + [c for c in cols if f and c not in f]

    def inner(c, t):
        if recursive and isinstance(t, T.StructType):
            return F.struct(*[inner(c.getField(x), t[x].dataType).alias(x) for x in sorted(t.names, key=key)])
        return c

    return s.select([inner(col(c), s.dtype(c)).alias(c) for c in order])


@verb("template", "-f=f:list -t=path:str --fill-with=fill:str")
def template(s: Stream, f=None, fill="", path=None) -> Stream:
    """Exactly the listed fields, in that order; what is missing is filled."""
    names = f or open(path).readline().strip().split(",")
    return s.select([_filled(s, c, fill).alias(c) if c in s.columns else F.lit(fill).alias(c) for c in dict.fromkeys(names)])


def _filled(s: Stream, c: str, fill: str):
    t = s.dtype(c)
    return F.coalesce(col(c), F.lit(fill)) if isinstance(t, T.StringType) else col(c) if not isinstance(t, T.NumericType) else F.coalesce(col(c), F.lit(fill).try_cast(t))


@verb("unsparsify", "--fill-with=fill:str -f=f:list")
def unsparsify(s: Stream, fill="", f=None) -> Stream:
    """Absent fields filled; with ``f``, those only, and added where no record has them."""
    names = f or s.columns
    new = {}
    for c in names:
        new[c] = _filled(s, c, fill) if c in s.columns else F.lit(fill)
    return s.with_columns(new)


@verb("sparsify", "-s=filler:str -f=f:list")
def sparsify(s: Stream, filler="", f=None) -> Stream:
    """Fields whose value is the filler become absent."""
    new = {}
    for c in s.columns:
        if (not f or c in f) and isinstance(s.dtype(c), T.AtomicType):
            new[c] = F.when(col(c).cast("string") != filler, col(c))
    return s.with_columns(new)


@verb("remove-empty-columns")
def remove_empty_columns(s: Stream) -> Stream:
    """Drop fields that are empty or absent in every record: one pass that finds them, then a projection."""
    cols = s.columns
    if not cols:
        return s
    got = s.df.agg(*[F.max(nonempty(s, c).cast("int")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return s.select([c for i, c in enumerate(cols) if got[i]])


@verb("group-like")
def group_like(s: Stream) -> Stream:
    """Records with the same fields side by side, groups by first appearance."""
    sign = F.concat_ws(",", *[F.when(col(c).isNotNull(), F.lit(c)) for c in s.columns])
    name = f"{HIDDEN}like"
    s = s.with_df(s.df.withColumn(name, sign))
    from .windows import regrouped

    return regrouped(s, [name])
