"""Token counts of a byte-level BPE by rank-synchronous array merging.

Pre-tokens are counted through a bounded memo; those not in it are held together as ragged numpy arrays
(one flat array of symbols and the sequence each belongs to). In every round each sequence's lowest-rank
pair is found by a segmented minimum and all its occurrences are merged, in all sequences at
once; what survives when no pair is left is the count. A merge's result only takes part in merges of
higher rank, so merging a sequence's lowest pair everywhere is what the one-at-a-time rule does.

The vocabulary is a tokenizers .json file of kind BPE with a byte-level pre-tokenizer; its path is a
parameter, and every executor reads it at that path. Added tokens inside a text count as one token each, as
that library does by default.

Defined results: a null text is empty; an empty text has 0 bytes and 0 tokens; repeated rows each get a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import Table, holds, narrowed, ragged, schema, task
from .pretokens import Recent, Splitter, slices

#: Pre-tokens of one generation of a worker's memo.
MEMO = 250_000


def byte_characters() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts the symbols that the merges leave of byte strings."""

    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE without normalizer is needed")
        self.prefix_space = spec["pre_tokenizer"]["add_prefix_space"]
        self.splitter = Splitter(pattern)
        added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.base = np.zeros(256, np.int64)
        for c, b in byte_characters().items():
            self.base[b] = vocab[c]
        self.width = max(vocab.values()) + 1
        pairs, results = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(vocab[a] * self.width + vocab[b])
            results.append(vocab[a + b])
        self.merges = Table(np.array(pairs, np.int64), np.arange(len(pairs)))  # the rank of each pair
        self.results = np.array(results, np.int64)
        self.memo = Recent(MEMO)

    def count_sequences(self, data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Surviving symbols of each of the stretches of ``data``, none of them empty."""
        total = lens.copy()
        sym = self.base[data[ragged(begin, lens)]]
        seq = np.repeat(np.arange(len(lens)), lens)
        none = np.int64(len(self.results))
        while len(sym) > 1:
            together = seq[1:] == seq[:-1]
            code = sym[:-1] * self.width + sym[1:]
            rank = self.merges.get(code.astype(np.uint64)).astype(np.int64)
            rank[~together | (rank < 0)] = none
            begin = np.flatnonzero(np.r_[True, ~together])  # of each sequence, in symbols
            lowest = np.minimum.reduceat(np.r_[rank, none], begin)  # a sequence's last place pairs with none
            mine = np.repeat(lowest, np.diff(np.r_[begin, len(sym)]))[:-1]
            hit = np.flatnonzero((rank < none) & (rank == mine))
            if not len(hit):
                break
            # of overlapping places (as in aaa) the first, third, ... of a run merge
            run = np.cumsum(np.r_[True, np.diff(hit) > 1]) - 1
            first = np.flatnonzero(np.r_[True, np.diff(run) > 0])
            hit = hit[(np.arange(len(hit)) - first[run]) % 2 == 0]
            sym[hit] = self.results[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            np.subtract.at(total, seq[hit], 1)
            # a sequence in which nothing merged is done
            live = (lowest < none)[np.cumsum(np.r_[True, ~together]) - 1]
            keep &= live
            sym, seq = sym[keep], seq[keep]
        return total

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The tokens of each of the texts between the offsets."""
        n, special, owner = len(off) - 1, np.zeros(len(off) - 1, np.int64), None
        raw = data.tobytes() if self.prefix_space or self.added else b""
        if self.prefix_space or self.added and self.added.search(raw):
            parts, owner = [], []  # what stands between added tokens is a text of its own
            for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                some = self.added.split(raw[a:z]) if self.added else [raw[a:z]]
                special[i] = len(some) - 1
                parts += [b" " + s if self.prefix_space and s and not s.startswith(b" ") else s for s in some]
                owner += [i] * len(some)
            data = np.frombuffer(b"".join(parts), np.uint8)
            off = np.r_[0, np.cumsum(np.array(list(map(len, parts)), np.int64))]
        begin, size, at = self.splitter.spans(data, off)
        values, row, _ = self.memo.rows(data, begin, size, lambda *new: (self.count_sequences(*new), np.ones(len(new[1]), np.int64)))
        total = np.r_[0, np.cumsum(values[row], dtype=np.int64)]
        own = total[at[1:]] - total[at[:-1]]
        if owner is not None:
            own = np.bincount(np.array(owner, np.int64), own, minlength=n).astype(np.int64)
        return own + special


@functools.lru_cache(4)
def merger(path: str, pattern: str) -> Merger:
    return Merger(path, pattern)


holds("token_counts", merger.cache_clear)


@task("token_counts")
def _count(batches, path: str, pattern: str, limit: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    m = merger(path, pattern)
    for batch in batches:
        column = batch.column(1)
        n = [m.counts(data, off) for _, _, data, off in slices(column)]
        size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
        tokens = pa.array(np.concatenate([*n, np.zeros(0, np.int64)]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    docs = narrowed(docs, doc_id="bigint", text="string")
    return docs.mapInArrow(lambda it: _count(it, path, pattern, limit), schema(doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean"))
