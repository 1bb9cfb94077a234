"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can stand last in the encoding of that prefix. It is
found from the shorter prefixes: of the tokens that end there, the one which the merges would leave
standing next to the last token of what precedes it. Storing these last tokens gives the encoding of every
prefix, so bytes can be appended exactly, and after an edit only the places behind it are worked out
anew until the tables agree again.

Two tokens stand next to each other in an encoding if undoing their merges, latest first, never shows a
pair across the seam that would have merged earlier.

The vocabulary is a rank file of tiktoken (base64 bytes, rank); its path is a parameter and every executor reads it there.

Defined results: a null text is empty; an empty text has no tokens, and the hashes of the empty string; repeated rows
each get a row; an empty table gives an empty result; further columns are ignored or, in ``encode_rows``, carried along.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Table, holds, mix, narrowed, ragged, schema, small_batches, task
from .pretokens import Hashes, Recent, Splitter, flat, slices

#: Pieces of one generation of a worker's memo.
MEMO = 250_000
#: Bits of the place of a token pair in a worker's table of the pairs asked last.
SEAM_BITS = 20
#: Bytes of a piece above which it is encoded on its own: the places of many are worked out in step.
LONG = 256


class Prefixes:
    """The last token of every prefix of a byte string, with appends and edits."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        self.data += more
        self._extend(len(self.data))
        return self

    def _extend(self, upto: int) -> None:
        data = bytes(self.data)
        while len(self.last) < upto:
            self.last.append(self.bpe.last_token(data, len(self.last) + 1, self.last))

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replace data[begin:end]; returns how many prefixes had to be worked out anew.

        A prefix's last token depends only on the longest-token stretch before it, by way of the last tokens there;
        once as many in a row as the longest token is long agree with the old table, all later ones do.
        """
        old = self.last[end:]
        self.data[begin:end] = new
        self.last = self.last[:begin]
        self._extend(begin + len(new))
        done, agree = len(new), 0
        data = bytes(self.data)
        for k, was in enumerate(old):
            self.last.append(self.bpe.last_token(data, len(self.last) + 1, self.last))
            done += 1
            agree = agree + 1 if self.last[-1] == was else 0
            if agree >= self.bpe.longest and k + 1 >= self.bpe.longest:
                self.last += old[k + 1 :]
                break
        return done

    def tokens(self, upto: int | None = None) -> list[int]:
        at, out = len(self.data) if upto is None else upto, []
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(self.bpe.bytes_of[t])
        return out[::-1]


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.longest = max(map(len, self.ranks))
        self.splitter = Splitter(pattern)
        self.memo = Recent(MEMO)
        self.ends: Table | None = None
        self.suffixes = {b[k:] for b in self.ranks for k in range(len(b))}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.split.update((t, (t, t)) for t, b in self.bytes_of.items() if len(b) == 1)
        for token in sorted(t for t, b in self.bytes_of.items() if len(b) > 1):  # by rank: a token's halves are known before it
            b = self.bytes_of[token]
            table: list[int] = []
            for i in range(1, len(b)):
                table.append(self.last_token(b, i, table))
            right = self._half(b, table, token)
            if right is None:
                self.split[token] = (token, token)  # no merge makes it
                continue
            left = self.ranks[b[: len(b) - len(self.bytes_of[right])]]
            self.split[token] = (left, right)
            self.pair[left, right] = token

    def _half(self, b: bytes, table: list[int], token: int) -> int | None:
        """The right one of the two tokens of which the token is merged: both of lower rank, standing next to each other without it."""
        for k in range(1, len(b)):
            right = self.ranks.get(b[k:])
            left = self.ranks.get(b[:k])
            if left is not None and right is not None and left < token and right < token and table[k - 1] == left and self.adjacent(left, right):
                return right
        return None

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two stand next to each other in the encoding of their bytes."""
        limit = 1 << 60
        split, pair = self.split, self.pair
        while True:
            merged = pair.get((left, right))
            if merged is not None and merged < limit:
                return False
            if left > right:  # the left one was merged later: undo it
                limit = left
                inner = split[left][1]
                if inner == left:
                    limit = right + 1
                    inner = split[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                limit = right + 1
                inner = split[right][0]
                if inner == right:
                    limit = left
                    inner = split[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that stands last in the encoding of data[:end], given those of all shorter prefixes."""
        ranks, suffixes, split = self.ranks, self.suffixes, self.split
        for begin in range(end - 1, -1, -1):
            b = data[begin:end]
            if b not in suffixes:
                break  # nor is any longer one the end of a token
            t = ranks.get(b)
            if t is None:
                continue
            if end - begin > 1:
                halves = split.get(t)
                if halves is None or halves[0] == t:
                    continue  # none that merges make
            if not begin:
                return t
            before = last[begin - 1]
            if self.adjacent(before, t):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def encode_scalar(self, piece: bytes) -> list[int]:
        """The encoding of one byte string by its table of last tokens."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else Prefixes(self, piece).tokens()

    def _arrays(self) -> None:
        """What ``encode_many`` looks up: all ends of tokens by hash, the merges by pair, lengths and halves by token."""
        if self.ends is not None:
            return
        size = max(self.bytes_of) + 1
        self.length, self.left, self.right = np.zeros(size, np.int64), np.arange(size), np.arange(size)
        self.spelt = np.zeros(size, np.int64)  # where a token's bytes stand among the letters
        self.letters = np.frombuffer(b"".join(self.bytes_of.values()), np.uint8)
        at = 0
        for t, b in self.bytes_of.items():
            self.length[t], self.spelt[t] = len(b), at
            at += len(b)
        tokens = np.array(list(self.bytes_of), np.int64)
        self.whole = Table(Hashes(self.letters).of(self.spelt[tokens], self.length[tokens]), tokens)
        for t, (left, right) in self.split.items():
            self.left[t], self.right[t] = left, right
        ends = sorted(self.suffixes)
        made = np.array([-1 if t is None or len(b) > 1 and self.split[t][0] == t else t for b, t in zip(ends, map(self.ranks.get, ends))], np.int32)
        size = np.array([len(b) for b in ends])
        self.ends = Table(Hashes(np.frombuffer(b"".join(ends), np.uint8)).of(np.cumsum(size) - size, size), made)
        pairs = np.array(list(self.pair), np.uint64).reshape(-1, 2)
        self.merges = Table(pairs[:, 0] << np.uint64(32) | pairs[:, 1], np.array(list(self.pair.values()), np.int32))
        self.asked, self.said = np.zeros(1 << SEAM_BITS, np.uint64), np.zeros(1 << SEAM_BITS, bool)

    def _stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``adjacent`` of many pairs at once."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        out = np.zeros(len(left), bool)
        limit = np.full(len(left), 1 << 60)
        live = np.arange(len(left))
        while len(live):
            a, b = left[live], right[live]
            merged = self.merges.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            ok = (merged < 0) | (merged >= limit[live])
            live, a, b = live[ok], a[ok], b[ok]
            # the one that was merged later is undone; one that no merge made stands, and the other is undone
            inner_a, inner_b = self.right[a], self.left[b]
            undo_a = a > b
            swap = np.where(undo_a, inner_a == a, inner_b == b)
            undo_a ^= swap
            limit[live] = np.where(undo_a, a, b + 1)
            done = np.where(undo_a, inner_a == a, inner_b == b)
            out[live[done]] = True
            left[live] = np.where(undo_a, inner_a, a)
            right[live] = np.where(undo_a, b, inner_b)
            live = live[~done]
        return out

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_stand`` by way of a table of the pairs asked last; a pair whose place another has taken is worked out anew."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) | np.uint64(1 << 63)
        at = (mix(key) >> np.uint64(64 - SEAM_BITS)).astype(np.int64)
        out = self.said[at]
        new = np.flatnonzero(self.asked[at] != key)
        if len(new):
            out[new] = self._stand(left[new], right[new])
            _, last = np.unique(at[new], return_index=True)  # a place holds one pair and its answer
            put = new[last]
            self.asked[at[put]], self.said[at[put]] = key[put], out[put]
        return out

    def encode_many(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in a row, and their numbers, of stretches of ``data``, none of them empty: the last tokens of all first prefixes are found at once, then those of all second ones, and so on."""
        self._arrays()
        hashes = Hashes(data)
        whole = self.whole.get(hashes.of(begin, size))
        count = np.ones(len(begin), np.int64)
        rest = np.flatnonzero((whole < 0) & (size <= LONG))
        rest = rest[np.argsort(-size[rest], kind="stable")]  # so that those that have a k-th prefix stand first
        of_rest, count[rest] = self._in_step(data[ragged(begin[rest], size[rest])], size[rest])
        far = np.flatnonzero(size > LONG)
        of_far = [self.encode_scalar(data[begin[i] : begin[i] + size[i]].tobytes()) for i in far.tolist()]
        count[far] = list(map(len, of_far))
        ids = np.empty(int(count.sum()), np.int32)
        place = np.cumsum(count) - count
        known = (whole >= 0) & (size <= LONG)
        ids[place[known]] = whole[known]
        ids[ragged(place[rest], count[rest])] = of_rest
        ids[ragged(place[far], count[far])] = [t for own in of_far for t in own]
        return ids, count

    def _in_step(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode_many`` of stretches that follow each other, the longest first."""
        if not len(size):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        hashes = Hashes(data)
        place = np.arange(int(size.sum()))
        prefix = place - np.repeat(begin, size) + 1
        # the tokens that end at each place, the longest first
        live, where, which = place, [], []
        for k in range(1, self.longest + 1):
            live = live[prefix[live] >= k]
            token = self.ends.get(hashes.of(live - (k - 1), k))
            live, token = live[token > -2], token[token > -2]
            if not len(live):
                break
            where.append(live[token >= 0])
            which.append(token[token >= 0])
        where, which = np.concatenate(where[::-1]), np.concatenate(which[::-1])
        by = np.argsort(where, kind="stable")
        which = which[by]
        first = np.r_[0, np.cumsum(np.bincount(where, minlength=len(place)))]
        last = np.zeros(len(place), np.int64)
        for end in range(1, int(size[0]) + 1):
            at = begin[: int(np.searchsorted(-size, -end, side="right"))] + end - 1
            at, stop = (at, first[at + 1])
            choice = first[at].copy()
            while len(at):
                if (choice >= stop).any():
                    raise ValueError("the vocabulary lacks a byte")
                token = which[choice]
                back = self.length[token]
                ok = back == end
                inner = np.flatnonzero(~ok)
                ok[inner] = self.stand(last[at[inner] - back[inner]], token[inner])
                last[at[ok]] = token[ok]
                at, stop, choice = at[~ok], stop[~ok], choice[~ok] + 1
        # back from the ends
        at, mine, steps = begin + size, np.arange(len(size)), []
        while len(mine):
            token = last[at[mine] - 1]
            steps.append((mine, token))
            at[mine] -= self.length[token]
            mine = mine[at[mine] > begin[mine]]
        mine = np.concatenate([m for m, _ in steps[::-1]])
        ids = np.concatenate([t for _, t in steps[::-1]])[np.argsort(mine, kind="stable")]
        return ids.astype(np.int32), np.bincount(mine, minlength=len(size))

    def encode_flat(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in a row of the texts whose UTF-8 bytes stand in ``data`` between the offsets, and the n + 1 places where each text's ids begin."""
        begin, size, at = self.splitter.spans(data, off)
        ids, row, count = self.memo.rows(data, begin, size, self.encode_many)
        return ids[ragged(row, count)], np.r_[0, np.cumsum(count)][at]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        ids, ends = self.encode_flat(*flat(texts))
        ids = ids.tolist()
        return [ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the n + 1 places where each id's begin."""
        self._arrays()
        size = self.length[ids]
        return self.letters[ragged(self.spelt[ids], size)], np.r_[0, np.cumsum(size)]


@functools.lru_cache(4)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


holds("bpe", bpe.cache_clear)


@task("bpe")
def _digests(batches, path: str, pattern: str):
    import pyarrow as pa

    b = bpe(path, pattern)
    for batch in batches:
        n, ids_hash, back_hash = [], [], []
        for _, _, data, off in slices(batch.column(1)):
            ids, at = b.encode_flat(data, off)
            back, end = b.decode_flat(ids)
            name = list(map(b.text_of.__getitem__, ids.tolist()))
            at, end = at.tolist(), end[at].tolist()
            for i in range(len(off) - 1):
                n.append(at[i + 1] - at[i])
                ids_hash.append(hashlib.sha256(",".join(name[at[i] : at[i + 1]]).encode()).hexdigest())
                back_hash.append(hashlib.sha256(back[end[i] : end[i + 1]]).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(back_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    docs = narrowed(docs, doc_id="bigint", text="string")
    return docs.mapInArrow(lambda it: _digests(it, path, pattern), schema(doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string"))


@task("bpe")
def _with_ids(batches, path: str, pattern: str, column: str, name: str):
    import pyarrow as pa

    b = bpe(path, pattern)
    for batch in batches:
        for a, z, data, off in slices(batch.column(batch.schema.get_field_index(column))):
            ids, ends = b.encode_flat(data, off)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            part = batch.slice(a, z - a)
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])


def encode_rows(docs: DataFrame, path: str, pattern: str, column: str = "text", name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``column`` as an array<int> column ``name``; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    kinds = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda it: _with_ids(it, path, pattern, column, name), kinds)


def decode_rows(rows: DataFrame, path: str, pattern: str, column: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of the ids in ``column`` as a binary column ``name``; null ids give null."""

    @task("bpe")
    def back(batches):
        import pyarrow as pa

        b = bpe(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
            out = pa.array([None if x is None else b.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    small_batches(rows.sparkSession)
    rows = rows.drop(name)
    return rows.mapInArrow(back, T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())]))
