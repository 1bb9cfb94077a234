"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is a language's 300 most frequent n-grams (one to three letters, words padded with a blank on either side) in order of
frequency. A text's own most frequent n-grams are compared to each profile by the out-of-place distance: the sum of the
differences of rank, and the greatest difference for an n-gram that the profile lacks. The least distance wins.

Profiles are learned from at most about ``per_language`` labelled documents of each language, picked by a hash of doc_id; counts
are pre-aggregated per task and language, and only the profiles, 300 n-grams for each language, come to the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled document all are
``und``; equal distances go to the first language by code point; repeated rows each get a row; an empty table gives an empty
result; further columns are ignored, or carried along by ``keep_known``.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrowed, schema, small_batches, task

SIZE = 300
PER_LANGUAGE = 5000


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams, sorted: up to three code points, 21 bits each, a blank as 1."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[raw], raw, np.uint32(0))
    keep = np.r_[True, (c[1:] != 0) | (c[:-1] != 0)] if len(c) else np.zeros(0, bool)
    c = np.r_[0, c[keep], 0].astype(np.int64)
    letter = c > 1
    if not letter.any():
        return np.zeros(0, np.int64)
    v = np.where(letter, c, 1)
    two = (v[:-1] << 21) | v[1:]
    three = (two[:-1] << 21) | v[2:]
    out = np.concatenate([v[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
    out.sort()
    return out


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[begin], np.diff(np.r_[begin, len(codes)])


def most_frequent(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by code."""
    kind, n = counted(codes)
    if len(kind) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        at = np.flatnonzero(n >= least)
        kind, n = kind[at], n[at]
    return kind[np.argsort(-n, kind="stable")][:size]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], size: int = SIZE):
        self.names = sorted(ranked)
        self.size = size
        self.codes = np.array(sorted({c for v in ranked.values() for c in v}), np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, np.array(ranked[name], np.int64)), j] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how near it is: 1 for a text ranked as its profile, 0 for one that shares nothing."""
        grams = ngrams(text or "")
        if not len(grams) or not self.names:
            return "und", 0.0
        top = most_frequent(grams, self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == top, at, len(self.codes))
        rank = self.rank[at]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], 1.0 - float(apart[best]) / (self.size * len(top))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, size: int = SIZE) -> Profiles:
    """Profiles from the rows of ``docs`` (doc_id, text, lang) that are labelled and not held out.

    ``per_language`` bounds the rows that are read for each language: a language with more of them is sampled by a hash
    of doc_id to about that many.
    """
    train = narrowed(docs, doc_id="bigint", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    per = train.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")).collect()  # one row a language
    if not per:
        return Profiles({}, size)
    share = F.lit(0.0)
    for r in per:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, r["share"]))).otherwise(share)
    train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * float(1 << 30))

    @task("language_id")
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(ngrams(t))
            for lang, parts in by.items():
                kind, n = counted(np.sort(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kind), pa.string()), pa.array(kind), pa.array(n)], names=["lang", "code", "n"])

    counts = train.select("text", "lang").mapInArrow(count, schema(lang="string", code="bigint", n="bigint")).where("code is not null")
    total = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {r["lang"]: [] for r in per}
    for r in ranked.select("lang", "code", "rank").orderBy("lang", "rank").collect():  # 300 rows a language
        out[r["lang"]].append(r["code"])
    return Profiles({k: v for k, v in out.items() if v}, size)


@task("language_id")
def _predictions(batches, profiles: Profiles, at: int):
    import pyarrow as pa

    for batch in batches:
        lang, score = [], []
        for t in batch.column(at).to_pylist():
            name, s = profiles.predict(t)
            lang.append(name)
            score.append(s)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and lang where profiles are to be learned): ``doc_id, held_out, lang_pred, score``."""
    profiles = profiles or learn(docs)
    rows = narrowed(docs, doc_id="bigint", text="string")

    @task("language_id")
    def run(batches):
        for batch in _predictions(batches, profiles, 1):
            yield batch.select(["doc_id", "lang_pred", "score"])

    out = rows.mapInArrow(run, schema(doc_id="bigint", lang_pred="string", score="double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """``docs`` without the rows in no known language: those with no letter, and those whose nearest profile is farther than ``1 - least`` of the greatest distance."""
    small_batches(docs.sparkSession)
    profiles = learn(docs)
    at = docs.columns.index("text")

    @task("language_id")
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = map(profiles.predict, batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != "und" and score >= least for name, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
