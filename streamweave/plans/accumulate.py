"""Programs that accumulate into ``@variables`` and emit them at the end, as grouped aggregations.

``@sum[$a][$b] += $x; end { emit @sum, "a", "b" }`` groups by a and b; a level of keys that is not named is spread over fields.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from .stream import Stream, col

_OPS = {"+=": "sum", "min": "min", "max": "max", "=": "last", "*=": "product", ".=": "concat", "||=": "or", "&&=": "and"}


def _target(e):
    """Name and index expressions of ``@name[i][j]``, or None."""
    keys = []
    while e[0] == "index":
        keys.insert(0, e[2])
        e = e[1]
    return (e[1], keys) if e[0] == "oos" else None


def _step(st, guards=()):
    """(name, keys, how, value, guards) of one accumulating statement, or None."""
    if st[0] != "assign":
        return None
    t = _target(st[1])
    if t is None:
        return None
    name, keys = t
    op, e = st[2], st[3]
    if op == "=" and e[0] == "call" and e[1] in ("min", "max") and len(e[2]) == 2 and st[1] in e[2]:
        other = e[2][1] if e[2][0] == st[1] else e[2][0]
        return name, keys, e[1], other, guards
    if op == "=" and e[0] == "call" and e[1] in ("+", "*") and len(e[2]) == 2 and e[2][0] == st[1]:
        return name, keys, {"+": "sum", "*": "product"}[e[1]], e[2][1], guards
    if op in _OPS:
        return name, keys, _OPS[op], e, guards
    return None


def _mentions_vars(e) -> bool:
    if isinstance(e, tuple):
        return e[0] in ("oos", "allvars") or any(_mentions_vars(x) for x in e)
    return isinstance(e, list) and any(_mentions_vars(x) for x in e)


def _steps(program):
    for st in program:
        if st[0] == "block":
            for inner in st[2]:
                yield _step(inner, (st[1],)) or inner
        elif st[0] not in ("begin", "end", "func", "subr"):
            yield _step(st) or st


def accumulates(program) -> bool:
    """Whether the program carries variables from record to record; one that is only set and used within a record does not count."""
    ends = [st for st in program if st[0] == "end"]
    return any(_is_step(x) and (x[2] != "last" or _names(ends, x[0]) or x[1]) for x in _steps(program))


def _assigned_in(body) -> list[str]:
    """Variables that a block assigns."""
    return [t[0] for st in body if st[0] == "assign" and (t := _target(st[1]))]


def _is_step(x) -> bool:
    return isinstance(x, tuple) and len(x) == 5 and isinstance(x[1], list) and isinstance(x[2], str)


def _names(e, name: str) -> bool:
    if isinstance(e, tuple) and e[:1] in (("oos",), ("allvars",)):
        return e[0] == "allvars" or e[1] == name
    return isinstance(e, (list, tuple)) and any(_names(x, name) for x in e)


def accumulated(s: Stream, program, presets=None) -> Stream:
    """The records that the end block emits."""
    from .dsl import Compiler, NotPlanned, _val, _with_context

    s = _with_context(s, program)
    c = Compiler(s, presets)
    c.run([st for st in program if st[0] in ("func", "subr")])
    begin = {}
    for st in program:
        if st[0] == "begin":
            for x in st[1]:
                t = _target(x[1]) if x[0] == "assign" else None
                if t and not t[1]:
                    begin[t[0]] = _val(c.eval(x[3], {}))
    steps = {}
    for x in _steps([st for st in program if st[0] not in ("begin", "end", "func", "subr")]):
        if len(x) == 5 and isinstance(x[1], list):
            name, keys, how, e, guards = x
            if _mentions_vars(e) or any(_mentions_vars(k) for k in keys):
                raise NotPlanned(f"@{name} depends on other variables: it takes one record after the other")
            if name in steps:
                raise NotPlanned(f"@{name} is assigned twice")
            guard = None
            for g in guards:
                p = F.coalesce(fn.boolean(_val(c.eval(g, {}))), F.lit(False))
                guard = p if guard is None else guard & p
            steps[name] = ([_val(c.eval(k, {})) for k in keys], how, _val(c.eval(e, {})), guard)
        elif _mentions_vars(x):
            raise NotPlanned("a record uses a variable that earlier ones have changed: it takes one record after the other")
        elif x[0] in ("assign", "local"):
            c.statement(x, {}, None)
    outs = []
    for st in program:
        if st[0] == "end":
            for x in st[1]:
                if x[0] == "emit" and any(_names(x[2], n) for n in _assigned_in(st[1])):
                    raise NotPlanned("the end block computes with variables")
                if x[0] == "emit":
                    things = []
                    for thing in x[2]:
                        if thing[0] == "allvars":
                            things += [(n, []) for n in steps]
                        elif thing[0] == "map":
                            outs.append(_mapped(s, thing, steps, begin))
                        else:
                            t = _target(thing)
                            if t is None or t[1]:
                                raise NotPlanned("the end block emits whole variables only")
                            things.append(t)
                    if things:
                        outs.append(_emit(s, [n for n, _ in things], [str(_val(c.eval(k, {})).literal) for k in x[3]], steps, begin, x[1] == "emitp"))
                elif x[0] == "emitf":
                    outs.append(_emit(s, [_target(e)[0] for e in x[1]], [], steps, begin, False))
                else:
                    raise NotPlanned(f"{x[0]} in an end block takes one record after the other")
    if not outs:
        return s.where(F.lit(False))
    from ..operators.joins import concat

    return outs[0] if len(outs) == 1 else concat(*outs)


def _aggregate(s: Stream, how: str, v, guard, start):
    x = v.c if guard is None else F.when(guard, v.c)
    n = fn.num(v) if guard is None else F.when(guard, fn.num(v))
    order = F.when(x.isNotNull(), s.first_key()) if s.order else F.lit(0)
    if how == "sum":
        # nothing to add is absent, not 0
        out = F.sum(n)
        return F.coalesce(out, F.lit(0)) + fn.num(start) if start is not None else out
    if how == "product":
        out = F.product(n.cast("double"))
        return out * fn.num(start) if start is not None else out
    if how in ("min", "max"):
        return getattr(F, how)(n if v.numeric or v.kind == "any" else x)
    if how == "last":
        down = not s.order or s.order[0][1]
        return (F.max_by if down else F.min_by)(x, order)
    if how == "concat":
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), fn.txt(v).alias("v")))), lambda r: r["v"]), "")
    return (F.bool_or if how == "or" else F.bool_and)(fn.boolean(v) if guard is None else F.when(guard, fn.boolean(v)))


def _emit(s: Stream, names, by, steps, begin, prefixed: bool) -> Stream:
    """Variables side by side (lashed), grouped by the named levels of their keys; further levels are spread over fields."""
    from ..operators.aggregates import grouped
    from .dsl import NotPlanned

    known = [n for n in names if n in steps]
    fixed = {n: begin[n].c for n in names if n not in steps and n in begin}
    if not known:
        return Stream(s.df.sparkSession.range(1).select(*[v.alias(n) for n, v in fixed.items()]))
    depth = len(steps[known[0]][0])
    if any(len(steps[n][0]) != depth for n in known):
        if by:
            raise NotPlanned("variables that are emitted together need keys of one depth")
        from ..operators.joins import concat

        return concat(*[_emit(s, [n], by, steps, begin, prefixed) for n in known])
    by = by[:depth]
    keys = steps[known[0]][0]
    held = s.with_columns({**{f"_k{i}": fn.txt(k) if k.kind in ("float",) else k.c for i, k in enumerate(keys)}})
    for i in range(depth):
        held = held.where(F.col(f"_k{i}").isNotNull())
    aggs = {}
    for n in known:
        _, how, v, guard = steps[n]
        aggs[f"_v:{n}"] = _aggregate(held, how, v, guard, begin.get(n))
    out = grouped(held, [f"_k{i}" for i in range(depth)], aggs)
    if len(by) == depth:
        shown = {n: col(f"_v:{n}") for n in known}
        cols = [F.col(f"_k{i}").alias(b) for i, b in enumerate(by)] + [v.alias(n) for n, v in shown.items()] + [v.alias(n) for n, v in fixed.items()]
        some = F.lit(False)
        for n in known:
            some = some | col(f"_v:{n}").isNotNull()
        return (out.where(some) if depth else out).select(cols)
    # the levels that are not named become fields; without any name, a record is split off for all levels but the last
    split = depth - 1 if not by and not prefixed and len(known) == 1 and depth > 1 else len(by)
    label = F.concat_ws(".", *[F.col(f"_k{i}").cast("string") for i in range(split, depth)])
    spread = out.with_df(out.df.withColumn("_f", label))
    first = spread.least() if spread.order and spread.uniform else F.min("_f")
    fields = [r[0] for r in spread.df.groupBy("_f").agg(first.alias("_o")).orderBy("_o").collect()]  # the field names
    cells = {}
    for n in known:
        for f in fields:
            cells[f"{n}.{f}" if prefixed or len(known) > 1 else f] = F.max(F.when(F.col("_f") == f, col(f"_v:{n}")))
    wide = grouped(spread, [f"_k{i}" for i in range(split)], cells)
    return wide.select([*[F.col(f"_k{i}").alias(b) for i, b in enumerate(by)], *cells])


def _mapped(s: Stream, thing, steps, begin) -> Stream:
    """``emit {"name": @var, ...}`` of variables without keys."""
    from .dsl import NotPlanned

    aggs = {}
    for key, e in thing[1]:
        t = _target(e)
        if t is None or t[0] not in steps or steps[t[0]][0]:
            raise NotPlanned("the end block computes with variables: it takes one record after the other")
        _, how, v, guard = steps[t[0]]
        aggs[key[1]] = _aggregate(s, how, v, guard, begin.get(t[0]))
    return Stream(s.df.agg(*[a.alias(k) for k, a in aggs.items()]))
