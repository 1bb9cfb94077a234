"""The join of two streams, and streams put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stream import HIDDEN, Stream, col
from .registry import verb


@verb("join", "-f=left:str -j=j:list -l=l:list -r=r:list --lk|--left-keep-field-names=lk:list --lp=lp:str --rp=rp:str --np=np:true --ul=ul:true --ur=ur:true --ignore-empty=ignore_empty:true -s|--sorted-input=merge:true -u=unsorted:true -i=fmt:str --prepipe=prepipe:str --prepipex=prepipex:str")
def join(s: Stream, left=None, j=None, l=None, r=None, lk=None, lp=None, rp=None, np=False, ul=False, ur=False, ignore_empty=False, merge=False, unsorted=False, fmt=None, prepipe=None, prepipex=None) -> Stream:  # noqa: E741
    """Equi-join of the left stream (a Stream, DataFrame or path) with this one, on the text of the key fields.

    Pairs follow this stream's order, then the left one's; unpaired lefts (``ul``) come last. Of fields of one name that
    are no keys, this stream's value stands in the left one's place; with a prefix both stay. Which side is
    broadcast, if any, is left to the sizes that Spark knows; ``merge`` asks for a sort-merge join.
    """
    if np and not (ul or ur):
        raise ValueError("join: no pairs and no unpaired records leave nothing")
    if isinstance(left, str):
        from ..sources.readers import read

        left = read(s.df.sparkSession, left, fmt)
    if isinstance(left, DataFrame):
        left = Stream.of(left)
    out_keys = list(j or l or r)
    lkeys, rkeys = list(l or j or r), list(r or j or l)
    ldf, rdf = left.df, s.df
    if lk is not None:
        keep = [c for c in left.columns if c in lk or c in lkeys]
        left = left.select(keep)
        ldf = left.df

    def keyed(df, keys, tag):
        return df.withColumns({f"_{tag}{i}": (col(k).cast("string") if k in df.columns else F.lit(None).cast("string")) for i, k in enumerate(keys)})

    def pairable(tag):
        out = F.lit(True)
        for i in range(len(out_keys)):
            out = out & F.col(f"_{tag}{i}").isNotNull()
            if ignore_empty:
                out = out & (F.col(f"_{tag}{i}") != "")
        return out

    # every column gets a name of its own side, so none can clash
    L = ldf.select(*[col(c).alias(f"L:{c}") for c in ldf.columns])
    R = rdf.select(*[col(c).alias(f"R:{c}") for c in rdf.columns])
    L = keyed(L, [f"L:{k}" for k in lkeys], "l")
    R = keyed(R, [f"R:{k}" for k in rkeys], "r")
    on = None
    for i in range(len(out_keys)):
        c = F.col(f"_l{i}") == F.col(f"_r{i}")
        on = c if on is None else on & c
    if merge:
        L = L.hint("merge")
    lrest = [c for c in left.columns if c not in lkeys]
    rrest = [c for c in s.columns if c not in rkeys]
    lname = {c: (lp or "") + c if lp is not None else c for c in lrest}
    rname = {c: (rp or "") + c if rp is not None else c for c in rrest}
    names = list(dict.fromkeys([*out_keys, *lname.values(), *rname.values()]))
    every = list(dict.fromkeys([*names, *lkeys * ul, *rkeys * ur]))
    rorder = [(f"{HIDDEN}r:{i}", up) for i, (_, up) in enumerate(s.order)]
    lorder = [(f"{HIDDEN}l:{i}", up) for i, (_, up) in enumerate(left.order)]

    def shown(values: dict, has_left: bool, has_right: bool):
        cols = [values.get(n, F.lit(None)).alias(n) for n in every]
        cols.append(F.lit(0 if has_right else 1).alias(f"{HIDDEN}j"))
        cols += [(col(f"R:{c}") if has_right else F.lit(None)).alias(n) for (n, _), (c, _) in zip(rorder, s.order)]
        cols += [(col(f"L:{c}") if has_left else F.lit(None)).alias(n) for (n, _), (c, _) in zip(lorder, left.order)]
        return cols

    parts = []
    good_l, good_r = L.where(pairable("l")), R.where(pairable("r"))
    if not np:
        values = {k: col(f"L:{lk_}") for k, lk_ in zip(out_keys, lkeys)}
        values |= {lname[c]: col(f"L:{c}") for c in lrest}
        values |= {rname[c]: col(f"R:{c}") for c in rrest}
        parts.append(good_r.join(good_l, on, "inner").select(*shown(values, True, True)))
    if ur:
        values = {rname[c]: col(f"R:{c}") for c in rrest} | {k: col(f"R:{k}") for k in rkeys}
        parts.append(R.join(good_l.select(*[f"_l{i}" for i in range(len(out_keys))]), on & pairable("r"), "left_anti").select(*shown(values, False, True)))
    if ul:
        values = {lname[c]: col(f"L:{c}") for c in lrest} | {k: col(f"L:{k}") for k in lkeys}
        parts.append(L.join(good_r.select(*[f"_r{i}" for i in range(len(out_keys))]), on & pairable("l"), "left_anti").select(*shown(values, True, False)))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    order = ((f"{HIDDEN}j", True), *rorder, *lorder)
    return Stream(df, order)


def concat(*streams: Stream) -> Stream:
    """Streams one after the other; a field that one of them lacks is absent there."""
    out, ups = None, {}
    for i, s in enumerate(streams):
        if any(up != streams[0].order[k][1] for k, (_, up) in enumerate(s.order[: len(streams[0].order)])):
            raise ValueError("concat: the streams' orders run in different directions")
        # keys of one place and type share a column; of another stream's it is NULL, and streams are apart already
        keys = {f"{HIDDEN}c{k}:{s.dtype(c).simpleString()}": (c, up) for k, (c, up) in enumerate(s.order)}
        ups |= {n: up for n, (_, up) in keys.items()}
        df = s.df.select(*map(col, s.columns), F.lit(i).alias(f"{HIDDEN}c"), *[col(c).alias(n) for n, (c, _) in keys.items()])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return Stream(out, ((f"{HIDDEN}c", True), *[(n, ups[n]) for n in sorted(ups, key=lambda n: int(n.split(":")[1][1:]))]))
