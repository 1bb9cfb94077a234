"""What several operators of this subpackage share: cuts of lineage, global numbering, components, word and shingle hashing."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# ---------------------------------------------------------------- session


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; where that is unset, a temporary one, but only on one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


#: Rows of an Arrow batch at most, where texts go through Python: 10000 of them would be held several times over by JVM and worker.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of BATCH_ROWS at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark can write one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: a reliable checkpoint, so an executor that is lost takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect what nobody refers to any more: Spark then removes the shuffle files of tables that were cut since."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def narrowed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; further columns, whatever their names, do not reach the operator."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


# ---------------------------------------------------------------- hash buckets and prefix sums


def md5_key(*parts: Column) -> Column:
    """A reproducible random key, as hex text, of the parts; null and empty parts differ."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("∅")) for p in parts]))


def unit(key: Column) -> Column:
    """The first 32 bits of a hex key as a double in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def with_offsets(df: DataFrame, group: list[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per group and bucket the sums of all earlier buckets of the group, and the group's totals.

    Returns ``group + [bucket] + before_<name>, all_<name>``. The window runs over one
    pre-aggregated row per bucket, and callers choose about two buckets per shuffle
    partition, so that it holds thousands of rows, however many the table has.
    """
    per = df.groupBy(*group, bucket).agg(*[c.alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*group).orderBy(bucket) if group else Window.partitionBy().orderBy(bucket)
    every = Window.partitionBy(*group)
    out = [*group, bucket]
    for n in sums:
        out.append(F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{n}"))
        out.append(F.sum(n).over(every).alias(f"all_{n}"))
    return per.select(*out)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges ``a, b`` (long): rows ``node, component`` for every node on an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one
    grouped minimum and one join on the group's key, so no component has to fit into one
    task. Every round is cut into the shared folder; it ends when a round changes nothing.
    A node with a great many neighbours is spread: its minimum is pre-aggregated before the
    shuffle and the join is left to the skew handling of adaptive execution.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == (now[0], now[1]):
            break
        last = (now[0], now[1])
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)


def roots(up: np.ndarray) -> np.ndarray:
    """Of trees in an array of parents: the root of each node."""
    while True:
        next_up = up[up]
        if (next_up == up).all():
            return up
        up = next_up


def unite(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of each pair; only pairs of different trees are looked at one by one."""
    if not len(i):
        return
    up[:] = roots(up)
    a, b = up[i], up[j]
    apart = a != b
    for x, y in set(zip(a[apart].tolist(), b[apart].tolist())):
        while up[x] != x:
            x = int(up[x])
        while up[y] != y:
            y = int(up[y])
        if x != y:
            up[max(x, y)] = min(x, y)


# ---------------------------------------------------------------- the memory of Python workers

_HELD: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def holds(owner: str, drop: Callable[[], None]) -> None:
    """Say how the caches that an operator keeps in a worker are dropped."""
    _HELD[owner] = drop


def settle() -> None:
    """Give free memory back to the system: at the end of a task a worker may lie idle for long."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(owner: str):
    """A function over the batches of a task, of the operator ``owner``.

    Workers outlive tasks and stages. At its start, a task drops what other operators have cached in its worker; at its end,
    it gives free memory back.
    """

    def wrap(f):
        @functools.wraps(f)
        def run(batches, *args, **named):
            if _OWNER != [owner]:
                _OWNER[:] = [owner]
                for name, drop in _HELD.items():
                    if name != owner:
                        drop()
                settle()
            try:
                yield from f(batches, *args, **named)
            finally:
                settle()

        return run

    return wrap


# ---------------------------------------------------------------- words and shingles in flat arrays

#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_BYTE = np.random.default_rng(20250101).integers(0, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]).cumprod(dtype=np.uint64)
            _INV = np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]).cumprod(dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd base, and their inverses, modulo 2**64."""
    _powers(n)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an Arrow string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + at)[at:] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def chunks(off: np.ndarray, size: int = 0):
    """Row ranges of about ``size`` (or CHUNK) bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + (size or CHUNK), side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed_words(buf: np.ndarray, off: np.ndarray, spans: bool = False):
    """Of the texts between the offsets: a hash of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the n + 1 places where each text's words begin.

    With ``spans`` also the bytes, counted from the first offset, at which each word begins and ends.
    """
    low, high = int(off[0]), int(off[-1])
    b = buf[low:high]
    n = len(b)
    none = np.zeros(0, np.int64)
    if not n:
        return (np.zeros(0, np.uint64), np.zeros(len(off), np.int64), *[none] * (2 * spans))
    _powers(n + 1)
    word = ~_BLANK[b]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[np.asarray(off) - low] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * _POW[:n], out=run[1:])
        h = mix((run[ends] - run[starts]) * _INV[starts])
    at = np.searchsorted(starts, np.asarray(off) - low)
    return (h, at, starts, ends) if spans else (h, at)


class Table:
    """A hash table of 64-bit keys and 32-bit values in flat arrays, with open addressing; many keys are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.held = 0
        self._room(16)
        self.put(np.asarray(keys).astype(np.uint64), np.asarray(values).astype(np.int32))

    def _room(self, size: int) -> None:
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -2, np.int32)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys, none of which is there."""
        if 3 * (self.held + len(keys)) > len(self.keys):
            there = self.values != -2
            keys, values, self.held = np.append(self.keys[there], keys), np.append(self.values[there], values), 0
            self._room(1 << int(4 * len(keys)).bit_length())
        self.held += len(keys)
        at, todo = (mix(keys) & self.mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.values[at[todo]] == -2]
            self.keys[at[free]] = np.uint64(0)
            self.values[at[free]] = free  # the last one to name a free slot has it
            mine = self.values[at[free]] == free
            put, late = free[mine], free[~mine]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = np.concatenate([todo[np.isin(todo, free, assume_unique=True, invert=True)], late])
            at[todo] = (at[todo] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -2 where there is none."""
        at = (mix(keys) & self.mask).astype(np.int64)
        out = self.values[at]
        todo = np.flatnonzero((out != -2) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] != -2) & (self.keys[at[todo]] != keys[todo])]
        return out


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``begin[i], begin[i] + 1, ...``, ``count[i]`` of them for each i."""
    total = int(count.sum())
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int):
    """Yield for every text, in order, the sorted distinct hashes of its runs of ``width`` words; fewer words are one run, no word is an empty set."""
    for i, j in chunks(off):
        h, at = hashed_words(buf, off[i : j + 1])
        with np.errstate(over="ignore"):
            if len(h) >= width:
                s = np.zeros(len(h) - width + 1, np.uint64)
                for k in range(width):
                    s += h[k : len(h) - width + 1 + k] * _ODD[k]
                s = mix(s)
            else:
                s = np.zeros(0, np.uint64)
            for r in range(j - i):
                a, z = int(at[r]), int(at[r + 1])
                if z - a >= width:
                    yield np.unique(s[a : z - width + 1])
                elif z > a:
                    whole = np.uint64(z - a)
                    for k in range(z - a):
                        whole = whole + h[a + k] * _ODD[k + 1]
                    yield mix(np.array([whole], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def schema(**kinds: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in kinds.items()))
