"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its words (A-Z lower-cased), the weight being the count. For each of K hash functions and each
term, two Gamma(2, 1) values r, c and a uniform b come from a hash of the term; with
``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b + 1)`` the sample is the (term, t) of least a (Ioffe, 2010).
Two documents have the same sample with a chance equal to the generalised Jaccard similarity, sum of least over sum of
greatest counts. A fingerprint is K samples, 16 hash bits of each; the likeness of two is the share of places that agree.
All is worked out in flat arrays: every distinct (word, count) of a chunk once for all its documents.

Defined results: a null text is an empty one; a text without words has the fingerprint ``""``, like 1 to its equal and 0 to any
other; a document that is alone is its own next; rows are ordered by doc_id (nulls first), then by a hash of the text;
repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, hashed_words, mix, narrowed, partitions, schema, task

SAMPLES = 64
#: Bytes of text whose words are worked out together: what they share is worked out once.
TOGETHER = 1 << 21
_32 = np.uint64(32)


def _unit(x: np.ndarray) -> np.ndarray:
    """31 bits as a float in (0, 1)."""
    return ((x & np.uint64(0x7FFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-31)


def samples(words: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For every (word hash, count) and hash function: ln a, sortable, in the high 48 bits and 16 bits that name (word, t) in the low ones."""
    keys = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(words), k), np.uint64)
    for a in range(0, len(words), 4096):
        w = words[a : a + 4096, None]
        lw = np.log(counts[a : a + 4096]).astype(np.float32)[:, None]
        with np.errstate(over="ignore"):
            x = (w ^ keys) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> _32
            y = x * np.uint64(0xC4CEB9FE1A85EC53)
            y ^= y >> _32
            z = (y + w) * np.uint64(0x9FB21C651E98DF25)
            z ^= z >> _32
        r = -np.log(_unit(x) * _unit(x >> np.uint64(33)))
        c = -np.log(_unit(y) * _unit(y >> np.uint64(33)))
        b = _unit(z)
        t = np.floor(lw / r + b)
        la = np.log(c) - r * (t - b + np.float32(1))
        bits = la.astype(np.float32).view(np.int32).astype(np.int64)
        order = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31)
        with np.errstate(over="ignore"):
            name = mix(w * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
        out[a : a + 4096] = (order.astype(np.uint64) << np.uint64(16)) | name
    return out


def fingerprints(texts: list[bytes], k: int = SAMPLES) -> list[np.ndarray | None]:
    """The K samples of each text (uint16); None without words."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    out: list[np.ndarray | None] = []
    for i, j in chunks(off, TOGETHER):
        h, at = hashed_words(buf, off[i : j + 1])
        doc = np.repeat(np.arange(j - i), np.diff(at))
        word, code = np.unique(h, return_inverse=True)
        pair, count = np.unique(doc * max(1, len(word)) + code, return_counts=True)
        doc, code = pair // max(1, len(word)), pair % max(1, len(word))
        most = int(count.max()) + 1 if len(count) else 1
        kind, where = np.unique(code * most + count, return_inverse=True)
        table = samples(word[kind // most], (kind % most).astype(np.float64), k)
        begin = np.searchsorted(doc, np.arange(j - i + 1))
        for r in range(j - i):
            a, z = begin[r], begin[r + 1]
            out.append((table[where[a:z]].min(axis=0) & np.uint64(0xFFFF)).astype("<u2") if z > a else None)
    return out


def written(f: np.ndarray | None) -> str:
    return "" if f is None else base64.b64encode(f.tobytes()).decode()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def fingerprint_rows(docs: DataFrame, k: int = SAMPLES) -> DataFrame:
    """The general interface: ``doc_id, fingerprint`` per row of ``docs`` (doc_id, text)."""

    @task("fingerprints")
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(f) for f in got], pa.string())], names=["doc_id", "fingerprint"])

    return narrowed(docs, doc_id="bigint", text="string").mapInArrow(run, schema(doc_id="bigint", fingerprint="string"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many of the next text's first, or all there are."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@task("fingerprints")
def _in_order(batches, k: int):
    """Rows bucket, last, doc_id, text in order: each row of a bucket with the next one; the bucket's last row (``last`` = 1) only follows."""
    import pyarrow as pa

    held = None  # bucket, last, doc_id, text, fingerprint
    done: list[tuple] = []

    def flush():
        texts = [x[1].encode() for x in done] + [e.encode() for e in (x[4] for x in done)]
        own = [x[2] for x in done]
        changed = fingerprints(texts[len(done) :], k)
        rows = [
            (x[0], len(x[1]), hashlib.sha256(t).hexdigest(), written(f), written(g), likeness(f, g), likeness(f, x[3]))
            for x, t, f, g in zip(done, texts[len(done) :], own, changed)
        ]
        done.clear()
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            bucket, last, ids = (batch.column(i).to_pylist() for i in range(3))
            texts = [t or "" for t in batch.column(3).to_pylist()]
            prints = fingerprints([t.encode() for t in texts], k)
            for row in zip(bucket, last, ids, texts, prints):
                if held is not None:
                    if held[0] != row[0] or held[1]:
                        raise ValueError("a bucket's rows do not follow each other")
                    done.append((held[2], held[3], held[4], row[4], edited(held[3], row[3])))
                    size += len(held[3])
                held = None if row[1] else row
                if size > 3_000_000:
                    yield flush()
                    size = 0
    if held is not None:
        raise ValueError("a bucket has no last row")
    yield flush()


def edits(docs: DataFrame, k: int = SAMPLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Rows are dealt once, by ranges of doc_id whose bounds are quantiles (about four a shuffle partition), those of a doc_id
    that several quantiles fall on, or of none, by ranges of the text's hash besides; each range also gets the first row of the next one, so that every row has its next at hand.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    docs = narrowed(docs, doc_id="bigint", text="string").withColumn("_tie", F.xxhash64("text"))
    cuts = [i / n for i in range(1, n)]
    got, whole, none = docs.agg(F.percentile_approx("doc_id", cuts, F.lit(max(10_000, 20 * n))) if cuts else F.lit(None), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()  # one row of n numbers
    bounds, often = np.unique(np.array(got or [], np.int64), return_counts=True)
    # ranges of the texts' hash that a bound's rows, and those without doc_id, are dealt to
    parts = np.where(often > 1, often + 1, 1)
    parts_of_none = -(-none * n // max(1, whole)) + 1

    @F.pandas_udf("bigint")
    def bucket_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        absent = ids.isna().to_numpy()
        ids = ids.fillna(0).astype("int64").to_numpy()
        b = np.searchsorted(bounds, ids, side="right")
        at = np.maximum(b - 1, 0)
        own = ~absent & (b > 0) & (bounds[at] == ids) if len(bounds) else np.zeros(len(ids), bool)
        m = np.where(absent, parts_of_none, parts[at] if len(bounds) else 1)
        share = (ties.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        part = np.where(own | absent, np.minimum((share * m).astype(np.int64), m - 1), m)  # rows above a bound come behind all of its parts
        return pd.Series(np.where(absent, -1, b) * (1 << 20) + part)

    rows = docs.withColumn("_bucket", bucket_of("doc_id", "_tie"))
    # the first row of each range: one small row each, whatever the table holds
    firsts = docs.select("doc_id", "_tie").withColumn("_bucket", bucket_of("doc_id", "_tie")).groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("f"))
    w = Window.orderBy("_bucket")
    every = Window.partitionBy()
    before = F.coalesce(F.lag("_bucket").over(w), F.max("_bucket").over(every)).alias("_to")
    firsts = firsts.select(before, F.col("f.doc_id").alias("_id"), F.col("f._tie").alias("_t"))
    heads = docs.join(F.broadcast(firsts), docs["doc_id"].eqNullSafe(firsts["_id"]) & docs["_tie"].eqNullSafe(firsts["_t"]))
    heads = heads.select(F.col("_to").alias("_bucket"), F.lit(1).alias("_last"), "doc_id", "text", "_tie").dropDuplicates(["_bucket"])
    dealt = rows.select("_bucket", F.lit(0).alias("_last"), "doc_id", "text", "_tie").unionAll(heads)
    dealt = dealt.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_last", "doc_id", "_tie").select("_bucket", "_last", "doc_id", "text")
    return dealt.mapInArrow(
        lambda it: _in_order(it, k),
        schema(doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double"),
    )
