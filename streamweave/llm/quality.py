"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on every document. Their votes make a pattern, and the patterns' counts over all
documents (at most 3**8 rows) hold all that expectation-maximisation needs: it estimates each labeller's accuracy, and each
pattern's probability of being good, without any true label. These probabilities are the labels on which a hashed linear scorer
is trained: logistic regression on hashed byte trigrams and on the hashed levels of the labellers' measures. The scorer decides.

The scorer is fitted on at most about ``sample`` documents with at most about ``features`` features in all, picked by a hash of doc_id and
text; the pattern counts cover all. The levels at which the labellers vote were set while looking at labelled documents of the shared tables.

Defined results: a text that is null or has no word scores 0 and is rejected; repeated rows each get a row; an
empty table gives an empty result; further columns are ignored, or carried along by ``keep_good``.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, hashed_words, narrowed, schema, small_batches, task, texts

SAMPLE = 4000
#: Features of all documents that the scorer is fitted on, together: 8 bytes each on their way to the driver, 24 there.
FEATURES = 5_000_000
#: Buckets of the hashed features: a power of two.
BUCKETS = 1 << 14

#: Measure, at most so much votes good, more than so much votes bad, fewest words to vote. Fixed values.
LABELLERS = (
    ("symbols", 0.01, 0.03, 1),  # bytes that are symbols
    ("capitals", 0.2, 0.5, 5),  # ASCII letters that are capitals
    ("doubled", 0.02, 0.1, 1),  # doubled punctuation marks, per word
    ("adjacent", 0.05, 0.2, 5),  # words that are the one before
    ("recent", 0.25, 0.4, 8),  # words that are one of the three before
    ("unstopped", 0.98, 0.999, 30),  # words that do not end a sentence
    ("single", 0.15, 0.2, 5),  # words of one byte
    ("wordless", 0.03, 0.08, 1),  # words without a letter or digit
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|{}<>=~^_\\+@[]/`"]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!?.,;:#$%&*|-_=+~"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LETTER = _UPPER | _LOWER
_LETTER[48:58] = True
_LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_EDGES = np.array([0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9, 0.95, 0.98, 0.999])
_LEVELS = len(_EDGES) + 2


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.zeros(len(mask) + 1, np.float64)
    np.cumsum(mask, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def measures(buf: np.ndarray, off: np.ndarray):
    """Per text the words (n) and the eight measures (n x 8; NaN where there is nothing to measure)."""
    low = int(off[0])
    b, at = buf[low : int(off[-1])], np.asarray(off) - low
    h, words_at, start, end = hashed_words(buf, off, spans=True)
    words = np.diff(words_at).astype(np.float64)
    out = np.full((len(off) - 1, len(LABELLERS)), np.nan)
    if not len(b):
        return words, out
    with np.errstate(invalid="ignore", divide="ignore"):
        out[:, 0] = _sums(_SYMBOL[b], at) / np.diff(at)
        capital = _sums(_UPPER[b], at)
        out[:, 1] = capital / (capital + _sums(_LOWER[b], at))
        same = np.zeros(len(b), bool)
        same[1:] = (b[1:] == b[:-1]) & _PUNCTUATION[b[1:]]
        out[:, 2] = np.minimum(1, _sums(same, at) / words)
        first = np.repeat(words_at[:-1], np.diff(words_at))
        place = np.arange(len(h)) - first
        near = np.zeros(len(h), bool)
        for k in (1, 2, 3):
            again = np.zeros(len(h), bool)
            again[k:] = (h[k:] == h[:-k]) & (place[k:] >= k)
            near |= again
            if k == 1:
                out[:, 3] = _sums(again, words_at) / words
        out[:, 4] = _sums(near, words_at) / words
        out[:, 5] = 1 - _sums(_STOP[b[end - 1]], words_at) / words if len(h) else np.nan
        out[:, 6] = _sums(end - start == 1, words_at) / words
        letters = np.r_[0, np.cumsum(_LETTER[b])]
        out[:, 7] = _sums(letters[end] == letters[start], words_at) / words
    out[words == 0] = np.nan
    return words, out


def votes(words: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """0 nothing, 1 good, 2 bad; n x 8."""
    out = np.zeros(measured.shape, np.int64)
    for j, (_, good, bad, fewest) in enumerate(LABELLERS):
        v = measured[:, j]
        able = ~np.isnan(v) & (words >= fewest)
        out[able & (v <= good), j] = 1
        out[able & (v > bad), j] = 2
    return out


_BASE3 = 3 ** np.arange(len(LABELLERS))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: the probability that each pattern is good, and each labeller's accuracy."""
    v = patterns[:, None] // _BASE3 % 3
    # the start: each labeller looks for one kind of fault, so a vote of bad weighs all votes of good
    p = np.where((v == 2).any(axis=1), 0.02, np.where((v == 1).any(axis=1), 0.98, 0.5))
    accuracy = np.full(len(LABELLERS), 0.5)
    for _ in range(rounds):
        n1, n0 = (counts * p).sum(), (counts * (1 - p)).sum()
        log1, log0 = np.full(len(p), np.log(n1 + 1)), np.full(len(p), np.log(n0 + 1))
        for j in range(v.shape[1]):
            said = v[:, j] > 0
            for k in (1, 2):  # to vote for nothing says nothing
                at = v[:, j] == k
                one, zero = (counts * p)[at].sum(), (counts * (1 - p))[at].sum()
                log1[at] += np.log((one + 0.1) / ((counts * p)[said].sum() + 0.2))
                log0[at] += np.log((zero + 0.1) / ((counts * (1 - p))[said].sum() + 0.2))
            right = (counts * p)[v[:, j] == 1].sum() + (counts * (1 - p))[v[:, j] == 2].sum()
            accuracy[j] = right / counts[said].sum() if counts[said].sum() else 0.5
        new = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, accuracy


def _trigrams(b: np.ndarray) -> np.ndarray:
    """The hashed bucket of the trigram at each byte but the last two."""
    x = b.astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _level_buckets(measured: np.ndarray) -> np.ndarray:
    """The hashed bucket of each measure's level, n x 8, behind those of the trigrams."""
    level = np.where(np.isnan(measured), _LEVELS - 1, np.searchsorted(_EDGES, np.nan_to_num(measured)))
    return BUCKETS + np.arange(measured.shape[1]) * _LEVELS + level


WIDTH = BUCKETS + len(LABELLERS) * _LEVELS
#: How much a trigram's share of a text counts against a level.
_SCALE = 4.0


@dataclasses.dataclass
class Model:
    patterns: dict[int, float]
    accuracy: np.ndarray
    weights: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; rows are buckets and values."""
    w, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return w, bias
    at = np.r_[0, np.cumsum([len(r[0]) for r in rows])]
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    who = np.repeat(np.arange(len(rows)), np.diff(at))
    m, v, mb, vb = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(who, w[idx] * val, len(rows)) + bias, -50, 50)))
        g = (p - labels) / len(rows)
        gw, gb = np.bincount(idx, g[who] * val, WIDTH) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(bias)


def learn(docs: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model of the rows of ``docs`` (doc_id, text). ``sample`` bounds the documents that the scorer is fitted on, ``features`` their features."""
    rows = narrowed(docs, doc_id="bigint", text="string")

    @task("quality")
    def seen(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = texts(batch.column(0))
            for i, j in chunks(off):
                words, measured = measures(buf, off[i : j + 1])
                code = (votes(words, measured) * _BASE3).sum(axis=1)
                kind, which, n = np.unique(code[words > 0], return_inverse=True, return_counts=True)
                held = np.bincount(which, np.minimum(np.diff(off[i : j + 1]), BUCKETS)[words > 0], len(kind)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(n), pa.array(held)], names=["pattern", "n", "held"])

    counted = rows.select("text").mapInArrow(seen, schema(pattern="bigint", n="bigint", held="bigint")).groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("held")).collect()  # 3**8 rows at most
    patterns, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.float64)
    if not len(patterns):
        return Model({}, np.full(len(LABELLERS), 0.5), np.zeros(WIDTH), -50.0)
    p, accuracy = estimate(patterns, counts)
    known = dict(zip(patterns.tolist(), p.tolist()))

    @task("quality")
    def features_of(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = texts(batch.column(0))
            for i, j in chunks(off):
                words, measured = measures(buf, off[i : j + 1])
                code = (votes(words, measured) * _BASE3).sum(axis=1)
                level = _level_buckets(measured)
                out = []
                for r in range(j - i):
                    if not words[r]:
                        continue
                    b = buf[off[i + r] : off[i + r + 1]]
                    idx, n = np.unique(_trigrams(b), return_counts=True) if len(b) > 2 else (np.zeros(0, np.int64), np.zeros(0))
                    idx, val = np.r_[idx, level[r]], np.r_[_SCALE * n / max(1, len(b) - 2), np.ones(level.shape[1])]
                    out.append((int(code[r]), idx.astype("<i4").tobytes(), val.astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["pattern", "idx", "val"])

    # a document of so many bytes has at most as many features
    share = min(1.0, sample / max(1.0, float(counts.sum())), features / max(1.0, float(sum(r[2] for r in counted))))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text") if share < 1 else rows.select("text")
    got = picked.mapInArrow(features_of, schema(pattern="bigint", idx="binary", val="binary")).orderBy("pattern", "idx", "val").toArrow()  # about ``sample`` rows
    data = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<f4")) for a, b in zip(got.column(1).to_pylist(), got.column(2).to_pylist())]
    weights, bias = train(data, np.array([known[x] for x in got.column(0).to_pylist()]))
    return Model(known, accuracy, weights, bias)


def scores(buf: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The scorer's probability of good, and that of the text's votes; 0 without words."""
    out, weak = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    w = model.weights
    for i, j in chunks(off):
        part = off[i : j + 1]
        words, measured = measures(buf, part)
        low = int(part[0])
        b, at = buf[low : int(part[-1])], part - low
        run = np.zeros(len(b) + 1)
        if len(b) > 2:
            np.cumsum(w[_trigrams(b)], out=run[1:-2])
            run[-2:] = run[-3]
        stop = np.maximum(at[:-1], at[1:] - 2)  # trigrams within the text
        n = np.maximum(1, at[1:] - 2 - at[:-1])
        linear = _SCALE * (run[stop] - run[at[:-1]]) / n + w[_level_buckets(measured)].sum(axis=1) + model.bias
        out[i:j] = np.where(words > 0, 1 / (1 + np.exp(-np.clip(linear, -50, 50))), 0.0)
        code = (votes(words, measured) * _BASE3).sum(axis=1)
        weak[i:j] = [model.patterns.get(c, 0.5) if n else 0.0 for c, n in zip(code.tolist(), words.tolist())]
    return out, weak


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, weak_label, score, kept`` (score of 0.5 or more)."""
    model = model or learn(docs)

    @task("quality")
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = texts(batch.column(1))
            s, weak = scores(buf, off, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(s), pa.array(s >= 0.5)], names=["doc_id", "weak_label", "score", "kept"])

    return narrowed(docs, doc_id="bigint", text="string").mapInArrow(run, schema(doc_id="bigint", weak_label="double", score="double", kept="boolean"))


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns."""
    small_batches(docs.sparkSession)
    model = model or learn(docs)
    at = docs.columns.index("text")

    @task("quality")
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = texts(batch.column(at))
            s, _ = scores(buf, off, model)
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
