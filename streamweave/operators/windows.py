"""Verbs that look at neighbouring records."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stream import HIDDEN, Stream, all_present, col, is_text, nonempty, number, present
from ..plans.ordered import neighbours, ranked, running, totals
from .registry import verb


def regrouped(s: Stream, g) -> Stream:
    """Records of a group side by side, groups in the order of their first records."""
    if not s.order:
        return s
    w = s.window(*g).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = [(F.first(col(c)).over(w), up) for c, up in s.order]
    return s.ordered_by(firsts, "group")


@verb("group-by", positional="names")
def group_by(s: Stream, names) -> Stream:
    """Records with the same values of the fields side by side; those that lack one are dropped."""
    return regrouped(s.where(all_present(s, names)), names)


@verb("count-similar", "-g=g:list -o=o:str")
def count_similar(s: Stream, g=(), o="count") -> Stream:
    """Each record with the size of its group; groups side by side."""
    s = s.where(all_present(s, g))
    return regrouped(s.with_columns({o: F.count("*").over(Window.partitionBy(*map(col, g)))}), g)


@verb("tac")
def tac(s: Stream) -> Stream:
    """The records in reverse: the order's directions turn, no row moves."""
    return Stream(s.df, tuple((c, not up) for c, up in s.order))


def type_rank(s: Stream, name: str) -> Column:
    """Numbers before texts before absent."""
    if is_text(s, name):
        return F.when(number(s, name).isNotNull(), 0).when(col(name).isNotNull(), 1).otherwise(2)
    return F.when(col(name).isNotNull(), 0).otherwise(2)


def natural_key(c: Column) -> Column:
    """A text whose order is natural: runs of digits padded to equal length."""
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))

    def ranked(p: Column) -> Column:
        """Digits behind the number of them, itself with its number of digits in front: longer runs come later, whatever their length."""
        bare = F.regexp_replace(p, "^0+(?=.)", "")
        size = F.char_length(bare).cast("string")
        return F.concat(F.lpad(F.char_length(size).cast("string"), 2, "0"), size, bare)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), ranked(p))).otherwise(p)), "")


@verb("sort", "-f=keys:sort-f -r=keys:sort-r -c=keys:sort-c -cr=keys:sort-cr -n|-nf=keys:sort-n -nr=keys:sort-nr -t=keys:sort-t -tr|-rt=keys:sort-tr -b=front:true")
def sort(s: Stream, keys=(), front=False) -> Stream:
    """Sort by fields, each lexically (f, r), without case (c, cr), by number (n, nr) or naturally (t, tr).

    Records that lack a field come last, in their order. In numeric order text follows the numbers, in both directions.
    """
    names = [k for k, _ in keys]
    missing = [n for n in names if n not in s.columns]
    if missing:
        return s
    out: list[tuple[Column, bool]] = [((~all_present(s, names)).cast("int"), True)]
    for name, how in keys:
        up = not how.endswith("r")
        kind = how.rstrip("r") or "f"
        if kind == "n":
            out += [(type_rank(s, name), True), (number(s, name), up)]
        elif kind == "c":
            out.append((F.lower(col(name).cast("string")), up))
        elif kind == "t":
            out.append((natural_key(col(name).cast("string")), up))
        else:
            out.append((col(name).cast("string"), up))
    s = s.ordered_by(out, "sort")
    if front:
        s = s.select(names + [c for c in s.columns if c not in names])
    return s


@verb("rank", "-f=f:list -g=g:list --sorted=sorted_input:true")
def rank(s: Stream, f=(), g=(), sorted_input=False) -> Stream:
    """Standard competition rank of each value, ascending, as ``x_rank``; absent values have none."""
    new = {}
    if not g:
        own = s.columns
        for x in f:
            s = ranked(s, [type_rank(s, x), number(s, x), col(x).cast("string")], f"{HIDDEN}rank")
            s = s.with_columns({f"{x}_rank": F.when(present(s, x), col(f"{HIDDEN}rank"))})
            s = s.with_df(s.df.drop(f"{HIDDEN}rank"))
        return s.select([*own, *[f"{x}_rank" for x in f]])
    for x in f:
        w = Window.partitionBy(*map(col, g)).orderBy(type_rank(s, x), number(s, x).asc_nulls_last(), col(x).cast("string").asc_nulls_last())
        ok = all_present(s, [x, *g])
        new[f"{x}_rank"] = F.when(ok, F.rank().over(w).cast("bigint"))
    return s.with_columns(new)


@verb("fraction", "-f=f:list -g=g:list -p=p:true -c=c:true")
def fraction(s: Stream, f=(), g=(), p=False, c=False) -> Stream:
    """Each value over its group's sum; times 100 (``p``); running (``c``)."""
    new = {}
    groups = [col(x) for x in g]
    own = s.columns
    if c and not g:
        s = running(s, {f"_run:{x}": number(s, x) for x in f})
    if not g:
        s = totals(s, {f"{HIDDEN}sum:{x}": F.sum(number(s, x)) for x in f})
    for x in f:
        v = number(s, x)
        ok = all_present(s, [x, *g]) & v.isNotNull()
        total = F.sum(F.when(ok, v)).over(Window.partitionBy(*groups)) if g else col(f"{HIDDEN}sum:{x}")
        top = v if not c else F.sum(F.when(ok, v)).over(s.window(*g).rowsBetween(Window.unboundedPreceding, 0)) if g else col(f"_run:{x}")
        name = f"{x}_{'cumulative_' * c}{'percent' if p else 'fraction'}"
        new[name] = F.when(ok, F.try_divide(top.cast("double") * (100 if p else 1), total.cast("double")))
    out = s.with_columns(new).select([*own, *new])
    return out.with_df(out.df.drop(*[f"{HIDDEN}sum:{x}" for x in f]))


@verb("fill-down", "-f=f:list -a|--only-if-absent=absent:true --all=every:true --only-if-blank=blank:true")
def fill_down(s: Stream, f=None, every=False, absent=False, blank=False) -> Stream:
    """The last value for a missing one: absent or empty, or (``absent``) only absent, or (``blank``) only empty."""
    names = s.columns if every else [x for x in f if x in s.columns]
    new, lasts = {}, {}
    for x in names:
        ok = present(s, x) if absent else (col(x).isNull() | nonempty(s, x)) & (col(x).isNotNull()) if blank else nonempty(s, x)
        lasts[f"_last:{x}"] = F.when(ok, col(x))
        last = col(f"_last:{x}")
        if blank:
            new[x] = F.when(col(x).isNull(), col(x)).otherwise(F.coalesce(last, col(x)))
        else:
            new[x] = F.coalesce(last, col(x))
    out = running(s, {}, lasts).with_columns(new)
    return out.select(s.columns)


def _reach(how: str) -> tuple[int, int] | None:
    """How many records before and behind a stepper looks at, if it looks at no more."""
    m = re.fullmatch(r"(?:delta|ratio|shift|shift_lag)(?:_(\d+))?", how)
    if m:
        return int(m[1] or 1), 0
    m = re.fullmatch(r"shift_lead(?:_(\d+))?", how)
    if m:
        return 0, int(m[1] or 1)
    m = re.fullmatch(r"slwin_(\d+)_(\d+)", how)
    return (int(m[1]), int(m[2])) if m else None


def _stepped(s: Stream, x: str, how: str, g, w=None) -> dict[str, Column]:
    m = re.fullmatch(r"(delta|ratio|shift|shift_lag|shift_lead)(?:_(\d+))?|slwin_(\d+)_(\d+)|(counter|ewma|from-first|rprod|rsum|count)", how)
    if not m:
        raise ValueError(f"step: no stepper {how}")
    w = w if w is not None else s.window(*g)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    kind = m[1] or m[5] or "slwin"
    n = int(m[2] or 1)
    v, raw = number(s, x), col(x)
    empty = ~nonempty(s, x) & present(s, x)
    out = f"{x}_{how}"

    def shown(c: Column) -> Column:
        """No field where the value is absent; where it is empty, nothing to compute."""
        return F.when(nonempty(s, x), c)

    if kind == "counter":
        return {out: shown(F.count(F.when(nonempty(s, x), 1)).over(run))}
    if kind == "delta":
        before = F.lag(F.when(~empty, v), n).over(w)
        return {out: shown(F.coalesce(v - before, F.lit(0)))}
    if kind == "ratio":
        before = F.lag(F.when(~empty, v), n).over(w)
        return {out: shown(F.coalesce(F.try_divide(v.cast("double"), before), F.lit(1.0)))}
    if kind in ("shift", "shift_lag"):
        return {out: F.when(present(s, x), F.lag(raw, n).over(w) if not is_text(s, x) else F.coalesce(F.lag(raw, n).over(w), F.lit("")))}
    if kind == "shift_lead":
        return {out: F.when(present(s, x), F.lead(raw, n).over(w) if not is_text(s, x) else F.coalesce(F.lead(raw, n).over(w), F.lit("")))}
    if kind == "from-first":
        return {out: shown(v - F.first(v, ignorenulls=True).over(run))}
    if kind == "rsum":
        return {out: shown(F.sum(v).over(run))}
    if kind == "rprod":
        return {out: shown(F.product(v).over(run))}
    if kind == "slwin":
        return {out: shown(F.avg(v).over(w.rowsBetween(-int(m[3]), int(m[4]))))}
    raise ValueError(f"step: no stepper {how}")


def _ewma(s: Stream, x: str, g, alphas, names) -> Stream:
    """Exponentially weighted averages: each needs the one before, so a group's records go by in order, a batch at a time, with what they carry.

    The other columns pass through Arrow as they are.
    """
    keys = [k for k in g]
    shares = [float(a) for a in alphas]
    new = [f"{x}_ewma_{n}" for n in (names or alphas)]
    df = s.df.withColumn("_v", number(s, x).cast("double"))
    df = df.repartition(*map(col, keys)) if keys else df.repartition(1)
    df = df.sortWithinPartitions(*map(col, keys), *s.by())
    kinds = T.StructType([*s.df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in new]])

    def run(batches):
        import pyarrow as pa

        last, held = None, [None] * len(shares)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("_v")).to_pylist()
            groups = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])) if keys else [()] * len(values)
            out: list[list] = [[] for _ in shares]
            for v, k in zip(values, groups):
                if last is None or k != last:
                    last, held = k, [None] * len(shares)
                for i, a in enumerate(shares):
                    if v is not None:
                        held[i] = v if held[i] is None else a * v + (1 - a) * held[i]
                    out[i].append(None if v is None else held[i])
            rest = [i for i, n in enumerate(batch.schema.names) if n != "_v"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *[pa.array(o, pa.float64()) for o in out]], names=[*[batch.schema.names[i] for i in rest], *new])

    out = s.with_df(df.mapInArrow(run, kinds))
    if keys:
        out = out.with_columns({n: F.when(all_present(s, keys), col(n)) for n in new})
    return out.select([*s.columns, *new])


@verb("step", "-a=a:list -f=f:list -g=g:list -d=d:list -o=o:list -F=float:true")
def step(s: Stream, a=("shift", "delta", "rsum", "counter"), f=(), g=(), d=("0.5",), o=None, float=False) -> Stream:
    """Steppers over the records of a group in order; records that lack a group field pass unchanged."""
    new, names, own = {}, [], s.columns
    ok = all_present(s, g)
    for x in f:
        if x in own:
            for how in a:
                if how == "ewma":
                    s = _ewma(s, x, g, d, o)
                    names += [f"{x}_ewma_{n}" for n in (o or d)]
                    continue
                if not g and how in ("rsum", "counter"):
                    name = f"{x}_{how}"
                    s = running(s, {name: number(s, x) if how == "rsum" else F.when(nonempty(s, x), 1).otherwise(0)})
                    new[name] = F.when(nonempty(s, x), col(name))
                    names.append(name)
                    continue
                if not g and _reach(how):
                    s = neighbours(s, lambda w, x=x, how=how: _stepped(s, x, how, g, w), *_reach(how))
                    names.append(f"{x}_{how}")
                    continue
                if not g and how == "rprod":
                    s = running(s, {}, products={f"{x}_rprod": number(s, x).cast("double")})
                    new[f"{x}_rprod"] = F.when(nonempty(s, x), col(f"{x}_rprod"))
                    names.append(f"{x}_rprod")
                    continue
                if not g and how == "from-first":
                    s = totals(s, {f"{HIDDEN}first": F.min_by(number(s, x), F.when(number(s, x).isNotNull(), s.first_key()))}) if s.order and s.uniform and s.order[0][1] else s
                    if f"{HIDDEN}first" in s.df.columns:
                        s = s.with_columns({f"{x}_from-first": F.when(nonempty(s, x), number(s, x) - col(f"{HIDDEN}first"))})
                        s = s.with_df(s.df.drop(f"{HIDDEN}first"))
                        names.append(f"{x}_from-first")
                        continue
                for name, c in _stepped(s, x, how, g).items():
                    new[name] = F.when(ok, c) if g else c
                    names.append(name)
    return s.with_columns(new).select([*own, *[n for n in names if n not in own]])


@verb("top", "-n=n:int -f=f:list -g=g:list -a=whole:true --max=max:true --min=min:true -F=float:true -o=o:str")
def top(s: Stream, f=(), n=1, g=(), whole=False, max=True, min=False, o=None, float=False) -> Stream:
    """The n greatest (or least) values of a group as ``top_idx, x_top``, padded to n rows; or their whole records."""
    s = s.where(all_present(s, [*g, *f]))
    for x in f:
        s = s.where(number(s, x).isNotNull())

    def w(x):
        v = number(s, x)
        return Window.partitionBy(*map(col, g)).orderBy(v.asc() if min else v.desc(), *s.by())

    if whole:
        out = s.with_df(s.df.withColumn("_rank", F.row_number().over(w(f[0]))).where(F.col("_rank") <= n))
        out = out.ordered_by([(F.col("_rank"), True)], "top")
        return regrouped(out.with_df(out.df.drop("_rank")), g) if g else out.with_df(out.df.drop("_rank"))
    groups = [col(x).alias(x) for x in g]
    parts = None
    for x in f:
        ranked = s.df.select(*groups, F.row_number().over(w(x)).alias("top_idx"), number(s, x).alias(o or f"{x}_top")).where(F.col("top_idx") <= n)
        parts = ranked if parts is None else parts.join(ranked, [*g, "top_idx"], "full")
    frame = s.df.select(*groups).distinct() if g else s.df.sparkSession.range(1).select()
    frame = frame.withColumn("top_idx", F.explode(F.sequence(F.lit(1), F.lit(n))))
    out = frame.join(parts, [*g, "top_idx"], "left")
    return Stream(out.select(*map(col, g), F.col("top_idx").cast("bigint").alias("top_idx"), *[col(o or f"{x}_top") for x in f])).ordered_by([*[(col(x), True) for x in g], (F.col("top_idx"), True)], "top")


@verb("gap", "-n=n:int -g=g:list")
def gap(s: Stream, n=None, g=None) -> Stream:
    """A record without values before every nth one, or where the group's fields change: here a row of NULLs in that place."""
    s = running(s, {}, number=f"{HIDDEN}at")
    at = col(f"{HIDDEN}at")
    if n:
        s = s.with_df(s.df.withColumn(f"{HIDDEN}gap", (at > 1) & ((at - 1) % n == 0)))
    else:
        key = F.concat_ws(",", *[col(x).cast("string") for x in g or ()])
        s = neighbours(s, lambda w: {f"{HIDDEN}gap": (at > 1) & ~F.lag(key).over(w).eqNullSafe(key)}, 1, 0)
    s = s.with_df(s.df.withColumn(f"{HIDDEN}at", at.cast("double")))
    blank = s.df.where(col(f"{HIDDEN}gap")).withColumn(f"{HIDDEN}at", col(f"{HIDDEN}at") - 0.5)
    blank = blank.withColumns({c: F.lit(None).cast(s.dtype(c)) for c in s.columns})
    return Stream(s.df.unionByName(blank), ((f"{HIDDEN}at", True),))

