"""Verbs that write on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.ordered import running
from ..plans.stream import HIDDEN, Stream, all_present, col
from .registry import verb


@verb("tee", "-a=append:true -p=pipe:true -o=fmt:str", "path")
def tee(s: Stream, path, append=False, pipe=False, fmt=None) -> Stream:
    """Write the records to a path as well, and pass them on."""
    if pipe:
        raise ValueError("tee: no pipes on a cluster")
    from ..sources.writers import write

    write(s, path, fmt, mode="append" if append else "overwrite")
    return s


@verb("split", "-n=n:int -m=m:int -g=g:list --prefix=prefix:str --suffix=suffix:str --folder=folder:str -a=append:true -v=passing:true -e=plain:true -j=jobs:int")
def split(s: Stream, n=None, m=None, g=None, prefix="split", suffix="csv", folder=".", append=False, passing=False, plain=False, jobs=None) -> Stream:
    """Records to several outputs: by values of fields (g), in turn among m, or n to each; one folder for each, named by its values or number.

    ``folder/prefix/<key>=<value>``: rows are dealt by the key, so each output is written by the tasks that hold it.
    """
    from ..sources.writers import write
    from .filters import nothing

    if g:
        s2, keys = s.where(all_present(s, g)), {f"{prefix}_{k}": col(k).cast("string") for k in g}
    else:
        s2 = running(s, {}, number=f"{HIDDEN}at")
        at = col(f"{HIDDEN}at") - 1
        key = at % m + 1 if m else F.floor(at / n) + 1
        keys = {f"{prefix}_part": key.cast("bigint")}
    write(s2.with_columns(keys), f"{folder}/{prefix}", suffix, mode="append" if append else "overwrite", by=list(keys))
    return s if passing else nothing(s)
