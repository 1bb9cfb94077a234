"""Verbs that draw records at random; with a seed they draw the same again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.stream import HIDDEN, Stream, all_present, col
from .registry import verb


@verb("shuffle", "--seed=seed:int")
def shuffle(s: Stream, seed=None) -> Stream:
    """The records in random order."""
    return Stream(s.df.withColumn(f"{HIDDEN}random", F.rand(seed)), ((f"{HIDDEN}random", True),))


@verb("sample", "-k=k:int -g=g:list --seed=seed:int")
def sample(s: Stream, k=10, g=(), seed=None) -> Stream:
    """k records of each group, every set of k as likely.

    With groups, each keeps its k least random keys; without, the least keys of each task are kept before they meet.
    """
    s = s.where(all_present(s, g))
    df = s.df.withColumn("_r", F.rand(seed))
    if not g:
        return s.with_df(df.orderBy("_r").limit(k).drop("_r"))
    w = Window.partitionBy(*map(col, g)).orderBy("_r")
    return s.with_df(df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_r", "_k"))


@verb("bootstrap", "-n=n:int --seed=seed:int")
def bootstrap(s: Stream, n=None, seed=None) -> Stream:
    """n records drawn with replacement (as many as there are, if not told)."""
    numbered = numbered_rows(s)
    total = s.df.count()
    n = total if n is None else n
    spark = s.df.sparkSession
    draws = spark.range(n).select(F.col("id").alias(f"{HIDDEN}draw"), F.floor(F.rand(seed) * total).cast("bigint").alias("_n"))
    df = draws.join(numbered, "_n").drop("_n")
    return Stream(df.select(*map(col, s.columns), col(f"{HIDDEN}draw")), ((f"{HIDDEN}draw", True),))


def numbered_rows(s: Stream):
    """Rows with ``_n``, 0 and on, without all of them in one task: a number within each partition, and where the partitions begin."""
    df = s.df.withColumn("_id", F.monotonically_increasing_id())
    df = df.withColumn("_p", F.shiftright(F.col("_id"), 33))
    sizes = df.groupBy("_p").agg(F.count("*").alias("_c"))
    begin = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return df.join(begin, "_p").withColumn("_n", F.col("_b") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_b", "_id")


@verb("bootstrap-ci", "-a=a:list -f=f:list -g=g:list -n=n:int -c=c:float -i=i:true --seed=seed:int")
def bootstrap_ci(s: Stream, a=("mean",), f=(), g=(), n=1000, c=0.95, i=False, seed=1) -> Stream:
    """Per group, field and statistic: the estimate, and the percentiles of n resampled ones as ``_lo`` and ``_hi``.

    Resampling a group needs all its values at hand; they come as one array of numbers a group.
    """
    from .aggregates import grouped
    from .statistics import resampled

    from ..plans.stream import nonempty, number

    s = s.where(all_present(s, g))
    held = grouped(s, g, {x: F.collect_list(F.when(nonempty(s, x), number(s, x).cast("double"))) for x in f})
    return resampled(held, a, f, g, n, c, i, seed)
