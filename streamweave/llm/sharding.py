"""Sharding by a Feistel permutation with cycle walking over global row numbers; DataFrame functions alone.

The rows are numbered 0 .. N-1 in the order of a reproducible key of doc_id and text, by ranges of that key
(buckets) sorted on their own and prefixed. The permutation then maps a number to its place in the
shuffle, and the place gives shard and slot: ``place mod shards`` and ``place div shards``. So the
shuffle can be computed, and inverted, for any number, and shards differ by one row at most.

The network works on Z_a x Z_b with ``a = ceil(sqrt(N))``, ``b = ceil(N / a)``: the halves are added to in turn
by a keyed function of the other. Of its ``a b < N + a`` values fewer than ``a`` lie beyond N; a
number whose image does is permuted again (cycle walking). A walk passes each of those values
once at most, so 64 steps are certain to do up to N = 4096, and beyond that the chance of
a longer walk is below N**-32; should one occur, the query fails rather than give a wrong place.

Defined results: a null text has no bytes and crc32 0; null doc_ids and repeated rows each get a place of their own
(ties are exchangeable rows); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import md5_key, narrowed, partitions, unit, with_offsets

ROUNDS = 6
STEPS = 64
_M = 1 << 31


def round_value(x: Column, key: int) -> Column:
    """A keyed mixing function of 31 bits; products stay below 2**62."""
    x = (x % _M * 1103515245 + (key * 12345 + 40503)) % _M
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * 1540483477) % _M
    return x.bitwiseXOR(F.shiftright(x, 13))


def permuted_once(x: Column, a: Column, b: Column, seed: int) -> Column:
    """The Feistel network, one pass, on x in [0, a b)."""
    left, right = F.floor(x / b).cast("bigint"), x % b
    # each round is one step of a fold: no expression repeats another's text
    start = F.struct(left.alias("l"), right.alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, acc["r"]).otherwise(acc["l"])
        v = round_value(other + i * 7919, seed)
        return F.struct(
            F.when(even, (acc["l"] + v) % a).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + v) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint")), start, step, lambda acc: acc["l"] * b + acc["r"])


def permute(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The place of number x in the shuffle of n; ``a`` and ``b`` as above."""
    first = permuted_once(x, a, b, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), first, lambda acc, _: F.when(acc >= n, permuted_once(acc, a, b, seed)).otherwise(acc)
    )
    return walk


def shards(docs: DataFrame, count: int = 16, seed: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``row_number``, its number before the shuffle."""
    p = partitions(docs.sparkSession)
    rows = narrowed(docs, doc_id="bigint", text="string").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).cast("bigint").alias("text_crc32")
    )
    rows = rows.withColumn("_key", md5_key(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.lit(seed))).withColumn("_bucket", F.floor(unit(F.col("_key")) * (2 * p)).cast("int"))
    offsets = with_offsets(rows, [], "_bucket", {"rows": F.count("*")}).withColumnRenamed("_bucket", "_b")
    rows = rows.join(offsets, F.col("_bucket") == F.col("_b"))
    inside = Window.partitionBy("_bucket").orderBy("_key", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("row_number", F.col("before_rows") + F.row_number().over(inside) - 1)
    rows = rows.withColumn("_a", F.ceil(F.sqrt("all_rows")).cast("bigint")).withColumn("_c", F.ceil(F.col("all_rows") / F.col("_a")).cast("bigint"))
    rows = rows.withColumn("_place", permute(F.col("row_number"), F.col("all_rows"), F.col("_a"), F.col("_c"), seed))
    rows = rows.withColumn("_place", F.when(F.col("_place") < F.col("all_rows"), F.col("_place")).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("bigint")))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % count).cast("int").alias("shard"),
        F.floor(F.col("_place") / count).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
