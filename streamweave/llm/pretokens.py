"""Pre-tokens of texts in flat arrays, and a bounded memo of what was worked out for them.

A pattern cuts a text into pieces. The pattern of the public byte-level vocabularies cuts wherever the kind of character (letter,
number, white space, other) changes, but for blanks that go with what follows them and for English contractions; it is
carried out on whole arrays of characters. Any other pattern goes piece by piece through the regex library. Both give the same pieces.

A piece is known by a 64-bit hash of its bytes, worked out from two prefix sums; two different pieces of one hash (chance
n**2 / 2**65 for the n pieces of a worker's memo) would be taken for equal.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import Table, powers, ragged

# Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of a piece up to which it is known by the sums alone.
SHORT = 256
_SPREAD = np.random.default_rng(20250102).integers(0, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)


class Hashes:
    """Hashes of stretches of bytes, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            power, self.inverse = powers(n + 1)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_SPREAD[data] * power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[begin + size] - self.sums[begin]) * self.inverse[begin] + np.asarray(size).astype(np.uint64)


class Splitter:
    """Cuts texts into the pieces that the pattern finds."""

    def __init__(self, pattern: str):
        import regex

        self.regex = regex.compile(pattern)
        self.kinds = None
        if pattern == PATTERN:
            every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
            self.kinds = np.full(len(every), OTHER, np.uint8)
            for kind, of_kind in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(of_kind, every):
                    self.kinds[m.start() : m.end()] = kind

    def spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts whose UTF-8 bytes stand in ``data`` between the offsets, from 0 to its length: the first byte and the
        size of every piece, and the n + 1 places where each text's pieces begin."""
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
        edges = np.searchsorted(starts, off)
        if self.kinds is None:
            return self._found(data, off, starts, edges)
        n = len(starts) - 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.kinds[char]
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        edge[0] = edge[n] = True
        begins = edge.copy()  # a piece begins here
        begins[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(begins)
        run, end = run[:-1], run[1:]
        what = kind[run]
        # the last character of white space within a text is a piece of its own, and a blank goes with what follows
        white = (what == SPACE) & ~edge[end]
        begins[end[white] - 1] = True
        begins[end[white & (char[end - 1] == 32)]] = False
        # a lone apostrophe at which a piece begins takes s, t, m, d, re, ve or ll of the letters behind it
        lone = np.flatnonzero((what == OTHER) & (end - run == 1) & (char[run] == 39) & begins[run] & ~edge[end])
        if len(lone):
            lone = lone[what[lone + 1] == LETTER]
            first = char[end[lone]]
            second = np.where(end[lone + 1] - end[lone] > 1, char[np.minimum(end[lone] + 1, n - 1)], 0)
            one = np.isin(first, [ord(c) for c in "stmd"])
            two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
            taken = np.where(one, 1, np.where(two, 2, 0))
            lone, taken = lone[taken > 0], taken[taken > 0]
            begins[end[lone]] = False
            begins[end[lone] + taken] = True
        piece = np.flatnonzero(begins[:n])
        byte = starts[np.append(piece, n)]
        return byte[:-1], np.diff(byte), np.searchsorted(piece, edges)

    def _found(self, data, off, starts, edges):
        raw = data.tobytes()
        begin, end, at = [], [], [0]
        for a, z, first in zip(off[:-1].tolist(), off[1:].tolist(), edges.tolist()):
            for m in self.regex.finditer(raw[a:z].decode()):
                if m.end() > m.start():
                    begin.append(first + m.start())
                    end.append(first + m.end())
            at.append(len(begin))
        begin, end = starts[np.array(begin, np.int64)], starts[np.array(end, np.int64)]
        return begin, end - begin, np.array(at)


class _Generation:
    def __init__(self):
        self.table = Table(np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        self.table.put(keys, np.arange(len(self.begin), len(self.begin) + len(keys), dtype=np.int32))
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.ids = np.append(self.ids, ids)


class Recent:
    """A bounded memo of two generations, from hashes of pieces to rows of integers: what is asked for again outlives the turn of a generation."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, _Generation(), _Generation()

    def rows(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of stretches of ``data``: integers, and where among them each stretch's row begins and how many it has.

        ``make(data, begin, size)`` gives the rows in a row, and their lengths, of stretches that all differ.
        """
        if len(self.young.begin) > self.most:
            self.young, self.old = _Generation(), self.young
        young, old = self.young, self.old
        keys = Hashes(data).of(begin, size)
        for i in np.flatnonzero(size > SHORT).tolist():
            raw = data[begin[i] : begin[i] + size[i]].tobytes()
            keys[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        slot = young.table.get(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            known = old.table.get(new)
            have = known >= 0
            if have.any():
                known = known[have]
                young.add(new[have], old.ids[ragged(old.begin[known], old.count[known])], old.count[known])
            if not have.all():
                at = missing[first[~have]]
                young.add(new[~have], *make(data, begin[at], size[at]))
            slot[missing] = young.table.get(keys[missing])
        return young.ids, young.begin[slot], young.count[slot]


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts in a row and the n + 1 places where each begins; None is an empty text."""
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(np.array(list(map(len, raw)), np.int64))]


def slices(column, most: int = 600_000):
    """An Arrow text column in runs of rows of about ``most`` bytes: first row, row behind the last, UTF-8 bytes, offsets from 0; a null is an empty text."""
    from .common import chunks, texts

    data, off = texts(column)
    for a, z in chunks(off, most):
        yield a, z, data[off[a] : off[z]], off[a : z + 1] - off[a]
