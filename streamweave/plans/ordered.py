"""Running values over a whole stream, without all of it in one task.

A window without groups is one task's work. Beyond ``LARGE`` bytes (as Spark estimates them) the stream is instead placed once: sorted by
ranges of its order and cut into the checkpoint folder, so that a row's partition is fixed. Each partition then runs its own
window, and what comes before it (rows, sums, the last value) is one small row per partition, prefixed and joined back.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stream import HIDDEN, Stream, col

#: From this size on (bytes) a stream is placed; 0 places every stream, as tests do.
LARGE = 256 << 20

_P, _I = "_o:part", "_o:place"


def size_of(df: DataFrame) -> int:
    """Spark's own estimate, made without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_large(s: Stream) -> bool:
    return bool(s.order) and size_of(s.df) >= LARGE


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``; where it is unset a temporary one, but only on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, cut into the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(s: Stream) -> Stream:
    """The stream with the number of its range and its place in it as columns."""
    spark = s.df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df = s.df.repartitionByRange(n, *s.by()).sortWithinPartitions(*s.by())
    df = df.withColumn(_P, F.spark_partition_id()).withColumn(_I, F.monotonically_increasing_id())
    return Stream(checkpointed(df), s.order)


def running(s: Stream, sums: dict[str, Column], lasts: dict[str, Column] | None = None, number: str | None = None, products: dict[str, Column] | None = None) -> Stream:
    """New columns over the stream in order: running sums and products, the last value that is not NULL so far, and the row's number (from 1)."""
    lasts, products = lasts or {}, products or {}
    if not is_large(s):
        w = s.window()
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        new = {k: F.sum(c).over(run) for k, c in sums.items()} | {k: F.last(c, ignorenulls=True).over(run) for k, c in lasts.items()}
        new |= {k: F.product(c).over(run) for k, c in products.items()}
        if number:
            new[number] = F.row_number().over(w).cast("bigint")
        return s.with_columns(new)
    p = placed(s)
    per = p.df.groupBy(_P).agg(
        F.count("*").alias("_run_n"), *[F.sum(c).alias(f"_run_s{i}") for i, c in enumerate(sums.values())],
        *[F.max_by(c, F.when(c.isNotNull(), col(_I))).alias(f"_run_l{i}") for i, c in enumerate(lasts.values())],
        *[F.product(c).alias(f"_run_p{i}") for i, c in enumerate(products.values())],
    )
    before = Window.orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    per = per.select(
        F.col(f"`{_P}`").alias("_run_q"), F.coalesce(F.sum("_run_n").over(before), F.lit(0)).alias("_run_n"), *[F.sum(f"_run_s{i}").over(before).alias(f"_run_s{i}") for i in range(len(sums))],
        *[F.last(f"_run_l{i}", ignorenulls=True).over(before).alias(f"_run_l{i}") for i in range(len(lasts))],
        *[F.product(f"_run_p{i}").over(before).alias(f"_run_p{i}") for i in range(len(products))],
    )
    df = p.df.join(F.broadcast(per), col(_P) == F.col("_run_q"))  # as many rows as there are shuffle partitions
    inner = Window.partitionBy(col(_P)).orderBy(col(_I))
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    for i, (k, c) in enumerate(sums.items()):
        own = F.sum(c).over(run)
        new[k] = F.when(own.isNull() & F.col(f"_run_s{i}").isNull(), own).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(F.col(f"_run_s{i}"), F.lit(0)))
    for i, (k, c) in enumerate(lasts.items()):
        new[k] = F.coalesce(F.last(c, ignorenulls=True).over(run), F.col(f"_run_l{i}"))
    for i, (k, c) in enumerate(products.items()):
        own = F.product(c).over(run)
        new[k] = F.when(own.isNull() & F.col(f"_run_p{i}").isNull(), own).otherwise(F.coalesce(own, F.lit(1.0)) * F.coalesce(F.col(f"_run_p{i}"), F.lit(1.0)))
    if number:
        new[number] = (F.row_number().over(inner) + F.col("_run_n")).cast("bigint")
    cells = {c: col(c) for c in s.columns} | new
    return Stream(df.select(*[v.alias(k) for k, v in cells.items()], *map(col, s.hidden)), s.order)


#: Rows that a task looks at together where rows only look at their neighbours.
TOGETHER = 1 << 18


def neighbours(s: Stream, new: Callable[[Window], dict[str, Column]], back: int, ahead: int) -> Stream:
    """New columns that look at no more than ``back`` rows before and ``ahead`` rows behind; ``new`` is given the window.

    A large stream is numbered first; then each stretch of ``TOGETHER`` rows also gets the rows that its first and last ones look at.
    """
    if not is_large(s):
        return s.with_columns(new(s.window()))
    n = running(s, {}, number=f"{HIDDEN}no")
    at = col(f"{HIDDEN}no") - 1
    size = max(TOGETHER, back + ahead + 1)
    own, place = F.floor(at / size), F.pmod(at, F.lit(size))
    to = F.array(own, F.when(place < ahead, own - 1), F.when(place >= size - back, own + 1))
    df = n.df.withColumn(f"{HIDDEN}to", F.explode(F.filter(to, lambda x: x.isNotNull())))
    w = Window.partitionBy(col(f"{HIDDEN}to")).orderBy(col(f"{HIDDEN}no"))
    cells = {c: col(c) for c in s.columns} | new(w)
    df = df.select(*[v.alias(k) for k, v in cells.items()], *map(col, s.hidden), (col(f"{HIDDEN}to") == own).alias(f"{HIDDEN}own"))
    return Stream(df.where(col(f"{HIDDEN}own")).drop(f"{HIDDEN}own"), s.order)


def ranked(s: Stream, keys: list[Column], name: str) -> Stream:
    """The standard competition rank of each row by ``keys``, ascending, nulls last: rows are placed by ranges of the keys, so that equal ones are together."""
    by = [k.asc_nulls_last() for k in keys]
    if not is_large(s):
        return s.with_columns({name: F.rank().over(Window.partitionBy().orderBy(*by)).cast("bigint")})
    sort = {f"{HIDDEN}k{i}": k for i, k in enumerate(keys)}
    n = int(s.df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df = s.df.withColumns(sort)
    by = [col(k).asc_nulls_last() for k in sort]
    df = checkpointed(df.repartitionByRange(n, *by).withColumn(_P, F.spark_partition_id()))
    before = Window.orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    per = df.groupBy(_P).agg(F.count("*").alias("_run_n")).select(F.col(f"`{_P}`").alias("_run_q"), F.coalesce(F.sum("_run_n").over(before), F.lit(0)).alias("_run_n"))
    df = df.join(F.broadcast(per), col(_P) == F.col("_run_q"))  # as many rows as there are shuffle partitions
    rank = (F.rank().over(Window.partitionBy(col(_P)).orderBy(*by)) + F.col("_run_n")).cast("bigint")
    cells = {c: col(c) for c in s.columns} | {name: rank}
    return Stream(df.select(*[v.alias(k) for k, v in cells.items()], *map(col, s.hidden)), s.order)


def totals(s: Stream, sums: dict[str, Column]) -> Stream:
    """Aggregates over the whole stream as columns of every row: one row, beside all."""
    return s.with_df(s.df.crossJoin(F.broadcast(s.df.agg(*[c.alias(k) for k, c in sums.items()]))))
