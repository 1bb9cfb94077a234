"""Verbs that keep some of the records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import Stream, all_present, col, java_regex, nonempty
from ..plans.ordered import running
from .registry import verb


@verb("head", "-n=n:int -g=g:list")
def head(s: Stream, n=10, g=()) -> Stream:
    """The first n records (of each group); with n below 0, all but the last -n."""
    if not g and n >= 0:
        return s.with_df((s.df.orderBy(*s.by()) if s.order else s.df).limit(n))
    if g:
        s = s.where(all_present(s, g))
    rank = F.row_number().over(s.window(*g, reverse=n < 0))
    out = s.df.withColumn("_rank", rank)
    return s.with_df(out.where(F.col("_rank") <= n if n >= 0 else F.col("_rank") > -n).drop("_rank"))


@verb("tail", "-n=n:str -g=g:list")
def tail(s: Stream, n=10, g=()) -> Stream:
    """The last n records (of each group); ``+n``: from the nth on."""
    from .windows import regrouped

    onward = isinstance(n, str) and n.startswith("+")
    n = int(n)
    if not g and not onward:
        back = s.with_df(s.df.orderBy(*s.by(reverse=True)).limit(n))
        return back
    if g:
        s = regrouped(s.where(all_present(s, g)), g)
    elif onward:
        return s.with_df(running(s, {}, number="_rank").df.where(F.col("_rank") >= n).drop("_rank"))
    rank = F.row_number().over(s.window(*g, reverse=not onward))
    return s.with_df(s.df.withColumn("_rank", rank).where(F.col("_rank") >= n if onward else F.col("_rank") <= n).drop("_rank"))


@verb("decimate", "-n=n:int -b=b:true -e=e:true -g=g:list")
def decimate(s: Stream, n=10, b=False, e=False, g=()) -> Stream:
    """One of each n records of a group: the last, or (``b``) the first."""
    if g:
        s = s.where(all_present(s, g))
        out = s.df.withColumn("_rank", F.row_number().over(s.window(*g)))
    else:
        out = running(s, {}, number="_rank").df
    return s.with_df(out.where((F.col("_rank") - 1) % n == (0 if b else n - 1)).drop("_rank"))


@verb("grep", "-i=i:true -v=v:true -a=a:true", "pattern")
def grep(s: Stream, pattern, i=False, v=False, a=False) -> Stream:
    """Records whose text ``k=v,k=v`` matches (``a``: their values, with blanks between)."""
    parts = [F.concat(F.lit("" if a else c + "="), col(c).cast("string")) for c in s.columns]
    hit = F.concat_ws(" " if a else ",", *parts).rlike(("(?i)" if i else "") + java_regex(pattern))
    return s.where(~hit if v else hit)


@verb("skip-trivial-records")
def skip_trivial_records(s: Stream) -> Stream:
    """Drop records in which every field is empty or absent."""
    some = F.lit(False)
    for c in s.columns:
        some = some | nonempty(s, c)
    return s.where(some)


@verb("nothing")
def nothing(s: Stream) -> Stream:
    """No record."""
    return s.where(F.lit(False))


@verb("check")
def check(s: Stream) -> Stream:
    """Read every record, give none; a field without a name is an error."""
    if "" in s.columns:
        raise ValueError("a field has an empty name")
    s.df.foreachPartition(lambda rows: [None for _ in rows] and None)
    return nothing(s)


@verb("fill-empty", "-v=v:str -S=text:true --only-if-blank=blank:true")
def fill_empty(s: Stream, v="N/A", text=False, blank=False) -> Stream:
    """Empty values become v (with ``blank`` also those of white space only)."""
    new = {}
    for c in s.columns:
        if isinstance(s.dtype(c), T.StringType):
            empty = col(c).rlike(r"^\s*$") if blank else col(c) == ""
            new[c] = F.when(empty, F.lit(v)).otherwise(col(c))
    return s.with_columns(new)


@verb("uniq", "-g|-f=g:list -x=x:list -c=c:true -n=n:true -o=o:str -a=a:true -d=d:true -u=u:true")
def uniq(s: Stream, g=None, x=None, c=False, n=False, o="count", a=False, d=False, u=False) -> Stream:
    """Distinct records or values of fields, with counts (``c``), their number (``n``), repeated (``d``) or single (``u``) ones only.

    A group's first record gives the result; so the groups come in the order of first appearance.
    """
    from .aggregates import grouped

    cols = s.columns
    keys = cols if a else [k for k in cols if k not in set(x)] if x else list(g or ())
    if not a:
        s = s.where(all_present(s, keys))
    if n:
        return Stream(s.df.select(*map(col, keys)).distinct().agg(F.count("*").alias("count")))
    if (d or u) and not a:
        size = F.count("*").over(_plain(s, keys))
        rank = F.row_number().over(s.window(*keys))
        out = s.df.withColumn("_size", size).withColumn("_rank", rank).where((F.col("_size") > 1 if d else F.col("_size") == 1) & (F.col("_rank") == 1))
        return s.with_df(out.drop("_size", "_rank"))
    out = grouped(s, keys, {o: F.count("*")})
    if a and (d or u):
        out = out.where(col(o) > 1 if d else col(o) == 1)
    if a:
        return out.select([o, *keys] if c else keys)
    return out.select([*keys, o] if c else keys)


def _plain(s: Stream, keys):
    from pyspark.sql import Window

    return Window.partitionBy(*map(col, keys))
