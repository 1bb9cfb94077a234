"""N-gram Jaccard join: documents whose shingle sets overlap by a share of their union, exactly.

A T-occurrence search, dealt out:

1. Every set becomes a *node*, named by a 64-bit hash of the set, so that equal sets, in
   whatever number, count once. With it go its size and a parity bitmap (below).
2. For a similarity t two sets of n and m members can only link if they share one of the
   first ``n - ceil(t n) + 1`` members of each, in any order that is the same for all. The
   order used puts the *long lists* last: shingles that stand in the hash-ordered prefixes of
   more than ``max(16, nodes / 10000)`` documents. These long lists are few (at most
   10000 prefix lengths, whatever the corpus), and are not merged but probed in step 5.
3. The short lists, shingle -> nodes, are dealt by shingle and merged: members of one list are
   compared by size and by the Hamming distance of their parity bitmaps, a lower bound of the
   sets' symmetric difference, so nothing that links is lost. Of the pairs that pass, a spanning forest
   leaves the task: at most one row per list entry, however large a group. What it connects is a block. A list above
   ``LIST`` nodes (of documents that are made of common passages alone) is dealt as pairs of chunks.
4. The sets of a block's nodes meet; a block above ``block`` nodes is dealt as pairs
   of chunks.
5. Each block is searched by DivideSkip: the lists that are longest are set aside, the short ones, each a
   sorted run, merged with their counts, the set-aside ones probed by binary search for those documents that
   can still reach the overlap, and the documents that reach ``ceil(t / (1 + t) (n + m))`` link.
   Pairs that are already connected within the task need no search.
6. Links become components.

Defined results: null text is an empty text; a text without words has an empty set, links with
nothing and is a component of itself; a text with fewer words than a shingle is one shingle;
repeated rows and equal texts share a component; an empty table gives an empty result; further
columns are ignored. A component that only stands under null doc_ids has a null component_id.
Two different sets of one node hash (chance n**2 / 2**65) would be taken as equal.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mix, narrowed, partitions, ragged, roots, schema, shingle_sets, task, texts, tidy, unite

#: Nodes of a block that are searched together.
BLOCK = 8192
#: Nodes of a list that are compared together.
LIST = 1024


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        h = mix(mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(mix(s)) + np.uint64(len(s)))
    return int(h.astype(np.int64))


def bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of n members: the power of two above n, at least 64."""
    return 1 << max(6, int(n).bit_length())


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the members whose hash falls on i. A change of one member changes one bit."""
    bits = bitmap_bits(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


@task("ngram_join")
def _signatures(batches, width: int, percent: int):
    import pyarrow as pa

    seen: set[int] = set()  # equal sets count once a task
    for batch in batches:
        buf, off = texts(batch.column(2))
        ns, nodes, maps, heads = [], [], [], []
        for s in shingle_sets(buf, off, width):
            node = node_of(s) if len(s) else None
            ns.append(len(s))
            nodes.append(node)
            maps.append(bitmap(s).tobytes() if len(s) else None)
            heads.append(None if node is None or node in seen else s[: prefix_length(len(s), percent)].astype(np.int64))
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(node)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
            names=["doc_id", "said", "n", "node", "bits", "head"],
        )


@task("ngram_join")
def _short_lists(batches, width: int, percent: int, long_lists):
    import pyarrow as pa

    long = long_lists.value
    seen: set[int] = set()  # equal sets of one task go out once
    for batch in batches:
        buf, off = texts(batch.column(0))
        keys, nodes, lens = [], [], []

        def flush():
            k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lens))], names=["key", "node"])

        for s in shingle_sets(buf, off, width):
            if not len(s):
                continue
            node = node_of(s)
            if node in seen:
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(node)
            p = prefix_length(len(s), percent)
            if len(long):
                at = np.searchsorted(long, s)
                at[at == len(long)] = 0
                is_long = long[at] == s
                if is_long[:p].any():
                    s = np.concatenate([s[~is_long], s[is_long]])
            keys.append(s[:p])
            nodes.append(node)
            lens.append(p)
            if len(keys) >= 2000:
                yield flush()
                keys, nodes, lens = [], [], []
        yield flush()


def _runs(batches, columns: int):
    """Numpy columns of whole runs of equal first columns, from batches that are sorted by them."""
    held: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        key = new[0]
        cutting = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cutting:
            for h, c in zip(held, new):
                h.append(c[:cutting])
            yield [np.concatenate(h) for h in held]
            held = [[c[cutting:]] for c in new]
        else:
            if held[0] and held[0][-1][-1] != key[0]:
                yield [np.concatenate(h) for h in held]
                held = [[] for _ in range(columns)]
            for h, c in zip(held, new):
                h.append(c)
    if held[0]:
        yield [np.concatenate(h) for h in held]


@task("ngram_join")
def _shared(batches, most: int):
    """Of rows sorted by key, node: the distinct ones whose key has two nodes or more. Lists of more than ``most`` nodes go out as pairs of chunks, each under a key of its own."""
    import pyarrow as pa

    for key, node in _runs(batches, 2):
        first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[first], node[first]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.repeat(np.diff(np.r_[begin, len(key)]), np.diff(np.r_[begin, len(key)]))
        some = (size > 1) & (size <= most)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(node[some])], names=["key", "node"])
        for at in begin[size[begin] > most].tolist():
            own = node[at : at + size[at]]
            parts = -(-len(own) // most)
            part = mix(own.astype(np.uint64)) % np.uint64(parts)
            for other in range(parts):
                rows = part != other
                low, high = np.minimum(part[rows], np.uint64(other)), np.maximum(part[rows], np.uint64(other))
                with np.errstate(over="ignore"):
                    name = mix(np.uint64(int(key[at]) % 2**64) + mix(low * np.uint64(parts) + high + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array(own[rows])], names=["key", "node"])


def _folded(bits: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(bits, np.uint64)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


@task("ngram_join")
def _marked(batches, percent: int):
    """Of rows key, n, node, bits sorted by key, n: pairs of a list that may link, as a spanning forest block, node.

    Rows of a list stand by size, so partners lie within a run; comparison goes by shifts, all lists at once.
    """
    import pyarrow as pa

    seen: set[tuple[int, int]] = set()
    for key, n, node, bits in _runs(batches, 4):
        words = np.array([max(1, bitmap_bits(x) // 64) for x in n])
        # bitmaps of the two or three sizes within a list's reach: its own and the two halves of it
        own = [_folded(b, w) for b, w in zip(bits, words)]
        up = np.arange(len(key))
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        reach = np.repeat(np.r_[begin[1:], len(key)], np.diff(np.r_[begin, len(key)]))
        for w in np.unique(words):
            rows = np.flatnonzero((words == w) | (words == 2 * w))
            place = np.full(len(key), -1, np.int64)
            place[rows] = np.arange(len(rows))
            matrix = np.stack([_folded(own[r].tobytes(), w) for r in rows]) if len(rows) else np.zeros((0, w), np.uint64)
            live = np.flatnonzero((words == w) & (np.arange(len(key)) + 1 < reach))
            shift = 1
            while len(live):
                other = live + shift
                ok = other < reach[live]
                live, other = live[ok], other[ok]
                near = n[live] * 100 >= percent * n[other]  # sizes ascend: beyond, none is near
                live, other = live[near], other[near]
                for a in range(0, len(live), 1 << 14):
                    i, j = live[a : a + (1 << 14)], other[a : a + (1 << 14)]
                    both = place[j] >= 0
                    i, j = i[both], j[both]
                    x = matrix[place[i]] ^ matrix[place[j]]
                    apart = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                    total = n[i] + n[j]
                    # |A & B| (100 + p) >= p (n + m)  <=>  |A ^ B| (100 + p) <= (100 - p) (n + m)
                    good = apart * (100 + percent) <= (100 - percent) * total
                    unite(up, i[good], j[good])
                shift += 1
        root = roots(up)
        keep = root != np.arange(len(up))
        out = [(int(b), int(v)) for b, v in zip(node[root[keep]], node[keep])]
        out = [x for x in dict.fromkeys(out) if x not in seen]
        if len(seen) > 1_000_000:
            seen.clear()
        seen.update(out)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["block", "node"])


class Lists:
    """Inverted lists of a block in flat arrays: list l is ``owner[begin[l]:begin[l + 1]]``, ascending; lists of one document are left out."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        new = np.r_[True, flat[1:] != flat[:-1]]
        first = np.flatnonzero(new)
        many = np.diff(np.r_[first, len(flat)]) > 1
        keep = np.repeat(many, np.diff(np.r_[first, len(flat)]))
        self.owner = owner[keep]
        code = (np.cumsum(many) - 1)[(np.cumsum(new) - 1)[keep]]
        self.begin = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64), len(code)]
        self.docs = len(sets)
        self.places = code * self.docs + self.owner  # ascending: what the binary search goes through
        by = np.argsort(self.owner, kind="stable")
        self.of = code[by]  # the lists of each document
        self.of_begin = np.searchsorted(self.owner[by], np.arange(self.docs + 1))


def t_occurrence(lists: Lists, query: int, need: int, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip: the documents on at least ``need`` of a document's inverted lists, and on how many.

    The ``L`` longest lists are set aside (``L = need / (mu log2(longest) + 1)``, mu = 0.01); the short ones are
    merged, and what they hold ``need - L`` times or more is looked up in the long ones by binary search.
    """
    none = np.zeros(0, np.int64)
    mine = lists.of[lists.of_begin[query] : lists.of_begin[query + 1]]
    if len(mine) < need or need < 1:
        return none, none
    size = lists.begin[mine + 1] - lists.begin[mine]
    by = np.argsort(size, kind="stable")
    mine, size = mine[by], size[by]
    if longest is None:
        longest = int(need / (0.01 * math.log2(max(2, int(size[-1]))) + 1))
    longest = max(0, min(longest, need - 1, len(mine) - 1))
    short, length = mine[: len(mine) - longest], size[: len(mine) - longest]
    merged = np.sort(lists.owner[ragged(lists.begin[short], length)], kind="stable")  # sorted runs, which this merges
    first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else none
    count = np.diff(np.r_[first, len(merged)])
    found = merged[first][count >= need - longest]
    count = count[count >= need - longest]
    long = mine[len(mine) - longest :]
    for a in range(0, len(long), 64):  # a document that can no longer reach ``need`` is not looked up again
        some = long[a : a + 64]
        places = (some[:, None] * lists.docs + found[None, :]).ravel()
        at = np.searchsorted(lists.places, places)
        at[at == len(lists.places)] = 0
        count = count + (lists.places[at] == places).reshape(len(some), -1).sum(axis=0)
        alive = count + max(0, len(long) - a - 64) >= need
        found, count = found[alive], count[alive]
        if not len(found):
            break
    return found, count


def search(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int):
    """Links of a block as a spanning forest: (node, node). With sides 0 and 1 both present, only pairs across them."""
    order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), int(nodes[i])))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    side = sides[order]
    across = bool((side == 0).any() and (side == 1).any())
    up = np.arange(len(order))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    lists = Lists([sets[i] for i in order])
    for q in range(len(order) - 1, -1, -1):
        n = int(sizes[q])
        least = (percent * n + 99) // 100  # the smallest partner
        need = -(-percent * (n + least) // (100 + percent))
        found, count = t_occurrence(lists, q, need)
        good = (found < q) & (count * (100 + percent) >= percent * (n + sizes[found]))
        if across:
            good &= side[found] != side[q]
        for d in found[good].tolist():
            a, b = top(q), top(d)
            if a != b:
                up[a] = b
                yield int(nodes[order[q]]), int(nodes[order[d]])


@task("ngram_join")
def _links(batches, width: int, percent: int):
    """Of rows task, node, side, text sorted by task: links."""
    import pyarrow as pa

    held: list[tuple] = []
    now = None

    def run(rows):
        nodes, sets, sides, seen = [], [], [], set()
        for node, side, s in rows:
            if node not in seen and node_of(s) == node:  # rows of one doc_id may differ in text
                seen.add(node)
                nodes.append(node)
                sets.append(s)
                sides.append(side)
        got = list(search(np.array(nodes, np.int64), sets, np.array(sides), percent)) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["a", "b"])

    for batch in batches:
        task, node, side = (batch.column(i).to_pylist() for i in range(3))
        buf, off = texts(batch.column(3))
        for t, v, d, s in zip(task, node, side, shingle_sets(buf, off, width)):
            if t != now and held:
                yield run(held)
                held = []
            now = t
            held.append((v, d, s))
    if held:
        yield run(held)


#: The columns by which rows are told apart: doc_id without null, whether it is null, the hash of the text.
ROW_KEY = ["_id", "_none", "_said"]


def _row_key(doc_id: Column, said: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_none"), said.alias("_said")]


def _grouped(docs: DataFrame, width: int, percent: int, block: int, most_of_list: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text): ``doc_id, said, n, node`` for each row, ``said`` a hash of its text; and ``node, least, component``
    for each set, ``least`` the first of the rows that have it (without doc_id, doc_id, said)."""
    spark = docs.sparkSession
    p = partitions(spark)
    if not 50 <= percent <= 100:
        raise ValueError("percent has to be from 50 to 100: bitmaps of sets are compared where one is at most twice the other")
    docs = narrowed(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("said"), "text")
    signed = cut(docs.mapInArrow(lambda it: _signatures(it, width, percent), schema(doc_id="bigint", said="bigint", n="bigint", node="bigint", bits="binary", head="array<bigint>")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "said")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))

    most = max(16, signed.where("head is not null").count() // 10_000)
    long = signed.select(F.explode("head").alias("key")).groupBy("key").count().where(F.col("count") > most).select("key")
    held = long.toArrow().column(0).to_numpy().astype(np.uint64)  # at most 10000 prefix lengths, see above
    held.sort()
    long_lists = spark.sparkContext.broadcast(held)

    short = docs.select("text").where("text is not null").mapInArrow(lambda it: _short_lists(it, width, percent, long_lists), schema(key="bigint", node="bigint"))
    shared = cut(short.repartition(p, "key").sortWithinPartitions("key", "node").mapInArrow(lambda it: _shared(it, most_of_list), schema(key="bigint", node="bigint")))
    compared = (
        shared.join(nodes.select("node", "n", "bits"), "node").select("key", "n", "node", "bits")
        .repartition(p, "key").sortWithinPartitions("key", "n", "node")
        .mapInArrow(lambda it: _marked(it, percent), schema(block="bigint", node="bigint"))
    )
    marked = compared.distinct()
    marked = cut(components(marked.select(F.col("block").alias("a"), F.col("node").alias("b"))).select(F.col("component").alias("block"), "node"))
    del short, shared, compared
    tidy(spark)
    # blocks of more nodes than one task takes go out as pairs of chunks
    sizes = marked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
    dealt = marked.join(sizes, "block").withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    task = F.xxhash64("block", F.least("c", "other"), F.greatest("c", "other"))
    dealt = dealt.select(task.alias("task"), "node", F.when(F.col("c") > F.col("other"), 1).otherwise(0).alias("side"))
    # the texts of marked nodes, one for each node
    wanted = nodes.join(marked.select("node").distinct(), "node").select("node", *_row_key(F.col("least.doc_id"), F.col("least.said")))
    own = docs.select(*_row_key(F.col("doc_id"), F.col("said")), "text").join(wanted, ROW_KEY).select("node", "text").dropDuplicates(["node"])
    links = (
        dealt.join(own, "node").select("task", "node", "side", "text").repartition(p, "task").sortWithinPartitions("task")
        .mapInArrow(lambda it: _links(it, width, percent), schema(a="bigint", b="bigint"))
    )
    groups = components(links)
    tidy(spark)
    return signed.select("doc_id", "said", "n", "node"), nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK, most_of_list: int = LIST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id``; a component is named by its least doc_id.

    Two rows link when ``100 * |intersection| >= percent * |union|`` of their sets of ``width``-word shingles; ``percent`` is 50 or more.
    """
    signed, named = _grouped(docs, width, percent, block, most_of_list)
    least = named.groupBy("component").agg(F.min("least.doc_id").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component_id")
    out = signed.join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, all its columns as they were: of those with the least doc_id (rows without one
    come last) one with the least hash of its text. Rows without a word are groups of their own, and all of them stay.

    What decides is the row's text: of two rows of one doc_id with different texts, each stays or goes with its own group.
    """
    _, named = _grouped(docs, width, percent, BLOCK, LIST)
    stays = named.groupBy("component").agg(F.min("least").alias("least")).select(*_row_key(F.col("least.doc_id"), F.col("least.said")))
    text = F.col("_row").getField("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", *_row_key(F.col("_row").getField("doc_id").cast("bigint"), F.xxhash64(text)), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_worded"))
    one = rows.where("_worded").join(stays, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)  # dealt once for both
    return one.select("_row").unionAll(rows.where("NOT _worded").select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
