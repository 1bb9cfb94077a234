"""Chains over streams that do not end.

Verbs that look at one record at a time run on a ``readStream`` as they are. Grouped statistics run as streaming aggregations: over
all that has come (complete or update mode), or by event time with a watermark. Steppers keep each group's state
between batches. Verbs that need the whole input have no meaning on such a stream and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.chain import split_chain
from ..plans.stream import Stream, col

#: Verbs that look at one record at a time.
RECORD_AT_A_TIME = {
    "cat", "cut", "label", "rename", "reorder", "regularize", "sort-within-records", "template", "unsparsify", "sparsify", "having-fields", "grep", "skip-trivial-records", "nothing", "fill-empty", "sub", "gsub", "ssub", "case",
    "clean-whitespace", "unspace", "format-values", "sec2gmt", "sec2gmtdate", "bar", "merge-fields", "nest", "reshape", "repeat", "flatten", "unflatten", "json-parse", "json-stringify", "altkv", "put", "filter", "utf8-to-latin1", "latin1-to-utf8",
}
#: Verbs that aggregate: over all that has come so far.
WINDOWED = {"count", "stats1", "count-distinct", "merge-fields"}


def live(df: DataFrame, links: str) -> DataFrame:
    """A chain over a streaming DataFrame; at most its last verb may aggregate."""
    from ..operators.registry import parse

    s = Stream(df)
    words = split_chain(links)
    for i, w in enumerate(words):
        verb, options = parse(w)
        last = i == len(words) - 1
        if verb.name not in RECORD_AT_A_TIME and not (last and verb.name in WINDOWED):
            raise ValueError(f"{verb.name} needs the end of its input")
        s = verb.run(s, **options)
    return s.rows()


def stats_by_time(df: DataFrame, names: list[str], fields: list[str], time: str, width: str, late: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Accumulators by event-time window (tumbling, or sliding by ``slide``) and group; records later than ``late`` behind are dropped."""
    from ..operators.aggregates import accumulators

    s = Stream(df.withWatermark(time, late))
    aggs = []
    for x in fields:
        table = accumulators(col(x).cast("double"), col(x).cast("string"), col(x).isNotNull())
        aggs += [table[n].alias(f"{x}_{n}") for n in names]
    w = F.window(col(time), width, slide) if slide else F.window(col(time), width)
    out = s.df.groupBy(w.alias("w"), *map(col, by)).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *map(col, by), *[a for a in out.columns if a not in ("w", *by)])


def sessions(df: DataFrame, by: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: runs of records no farther apart than ``gap``; their bounds and sizes."""
    out = df.withWatermark(time, late).groupBy(F.session_window(col(time), gap).alias("w"), col(by)).agg(F.count("*").alias("count"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), col(by), "count")


def stateful_steps(df: DataFrame, by: str, order: str, field: str) -> DataFrame:
    """``delta``, ``shift``, ``rsum`` and ``counter`` of a field by group, going on from batch to batch.

    Within a batch a group's records are taken in the order of ``order``; across batches in the order of arrival.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([*df.schema.fields, *[T.StructField(f"{field}_{n}", T.DoubleType()) for n in ("delta", "shift", "rsum")], T.StructField(f"{field}_counter", T.LongType())])
    state = T.StructType([T.StructField("last", T.DoubleType()), T.StructField("sum", T.DoubleType()), T.StructField("n", T.LongType())])
    if by not in kinds or order not in kinds or field not in kinds:
        raise ValueError("stateful_steps: no such field")

    def run(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last, total, n = held.get if held.exists else (None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        v = rows[field].astype("float64")
        before = v.shift(1)
        if len(before) and last is not None:
            before.iloc[0] = last
        rows[f"{field}_delta"] = (v - before).where(before.notna(), 0.0)
        rows[f"{field}_shift"] = before
        rows[f"{field}_rsum"] = v.cumsum() + total
        rows[f"{field}_counter"] = range(n + 1, n + 1 + len(rows))
        held.update((float(v.iloc[-1]), float(rows[f"{field}_rsum"].iloc[-1]), n + len(rows)))
        yield rows[out.names]

    return df.groupBy(col(by)).applyInPandasWithState(run, out, state, "append", "NoTimeout")
