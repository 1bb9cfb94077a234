"""Embedding near-dedup: a hierarchical navigable small-world graph per shard.

Vectors are compared within a label (and a dimension). Equal vectors count once, as a *unit* with its number of copies. The
units of a label are dealt by hash to shards of about ``shard`` units; each shard builds its graph, and every unit
is searched for in the graph of every shard (of two shards' units, those of the one in the graph of the other, so that each shard
serves half of the others). A task holds one shard's graph; the units that are searched for in it stream by in batches, those of at most
``AHEAD`` other shards in one task: beyond, further tasks build the graph again.

Beams widen in two ways: for the whole shard, whenever an audit against brute force (of up to 1024 of its own units, until 100 links
were seen, and of one in 128 of the units that stream by) finds less than ``audit_recall`` of the links, a unit's match with
itself left out; and for a single query, as long as its beam ends within the threshold. A beam as wide as the shard compares all of it.
Pairs are confirmed by the cosine in double precision. A shard returns, for every unit, the number of vectors it is linked to
and a spanning forest of the links, so that even a large group of near vectors gives no more rows than it has units, and what its
audits found. Links then become components.

Defined results: a vector that is null, empty, zero, or holds a null or a component that is not finite, and a vector without label,
links with nothing; vectors of different length are not compared; repeated rows of a vec_id count as vectors; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, narrowed, partitions, roots, schema, task, unite

#: Units of a graph, or as many as are SHARD_BYTES in double precision, if that is less.
SHARD = 8192
SHARD_BYTES = 64 << 20
#: Other shards whose units one task searches for.
AHEAD = 32
#: Links of a node on the lowest level and on the others; beam while building.
DEGREE, UPPER, BUILD = 32, 16, 64


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, without overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class SmallWorld:
    """HNSW over rows of length 1; many queries walk at once, in step."""

    def __init__(self, rows: np.ndarray, seed: int = 7):
        self.exact = rows
        self.x = rows.astype(np.float32)
        n = len(rows)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(UPPER)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # the highest first, so that the entry never changes
        self.level = level
        self.top = int(level.max()) if n else 0
        self.links = [np.full((n, DEGREE if lv == 0 else UPPER), -1, np.int32) for lv in range(self.top + 1)]
        self.entry = int(self.order[0]) if n else -1
        self.beam = min(n, BUILD)
        self.hit = self.truth = 0  # of all audits
        done = 1
        while done < n:
            some = self.order[done : done + max(1, min(256, done))]
            self._insert(some)
            done += len(some)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry)
        for lv in range(self.top, -1, -1):
            at = self.level[new] >= lv
            if not at.any():
                start, _ = self.walk(q, start, 4, lv)
                continue
            ids, near = self.walk(q, start, BUILD, lv)
            start = ids
            mine = new[at]
            # the others of the batch that reach this level are candidates too
            among = q[at] @ q[at].T
            np.fill_diagonal(among, -np.inf)
            ids = np.concatenate([ids[at], np.broadcast_to(mine, (len(mine), len(mine)))], axis=1)
            near = np.concatenate([near[at], among], axis=1)
            best = np.argsort(-near, axis=1, kind="stable")[:, :BUILD]
            ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
            ids = np.where(np.isneginf(near), -1, ids)
            picked = self.diverse(ids, near, min(UPPER, self.links[lv].shape[1]))
            self.links[lv][mine, : picked.shape[1]] = picked
            self._back(mine, picked, lv)

    def _back(self, mine: np.ndarray, picked: np.ndarray, lv: int) -> None:
        """Each picked node gets a link back; full ones choose anew."""
        to, frm = picked.ravel(), np.repeat(mine, picked.shape[1])
        ok = to >= 0
        to, frm = to[ok], frm[ok]
        by = np.argsort(to, kind="stable")
        to, frm = to[by], frm[by]
        nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
        room = self.links[lv].shape[1]
        wide = np.full((len(nodes), room + int(count.max() if len(count) else 0)), -1, np.int64)
        wide[:, :room] = self.links[lv][nodes]
        row = np.repeat(np.arange(len(nodes)), count)
        wide[row, room + np.arange(len(to)) - np.repeat(begin, count)] = frm
        for a in range(0, len(nodes), 256):
            w, v = wide[a : a + 256], nodes[a : a + 256]
            near = np.einsum("qmd,qd->qm", self.x[w], self.x[v])
            near[(w < 0) | (w == v[:, None])] = -np.inf
            best = np.argsort(-near, axis=1, kind="stable")
            w, near = np.take_along_axis(w, best, 1), np.take_along_axis(near, best, 1)
            w = np.where(np.isneginf(near), -1, w)
            w[:, 1:][w[:, 1:] == w[:, :-1]] = -1
            full = (w >= 0).sum(axis=1) > room
            out = np.full((len(v), room), -1, np.int64)
            if full.any():
                out[full] = self.diverse(w[full], near[full], room)
            if (~full).any():
                rest = np.sort(np.where(w[~full] < 0, np.iinfo(np.int64).max, w[~full]), axis=1)[:, :room]
                out[~full] = np.where(rest == np.iinfo(np.int64).max, -1, rest)
            self.links[lv][v] = out

    def diverse(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first: those nearer to the row's node than to any already taken; then the nearest of the rest."""
        ids, near = ids[:, : 2 * BUILD], near[:, : 2 * BUILD]
        q, c = ids.shape
        v = self.x[ids]
        between = np.einsum("qid,qjd->qij", v, v)
        taken = np.zeros((q, c), bool)
        closest = np.full((q, c), -np.inf, np.float32)
        for j in range(c):
            ok = (ids[:, j] >= 0) & (near[:, j] > closest[:, j]) & (taken.sum(axis=1) < most)
            taken[:, j] = ok
            closest[ok] = np.maximum(closest[ok], between[ok, j])
        rank = np.where(taken, 0, 1) * c + np.arange(c)
        rank[ids < 0] = 3 * c
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, pick, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def walk(self, q: np.ndarray, start: np.ndarray, beam: int, lv: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best-first search of one level: up to ``beam`` nodes for each query and their products, best first; -1 and -inf where fewer."""
        n, m = len(self.x), len(q)
        seen = np.zeros((m, n + 1), bool)
        rows = np.arange(m)[:, None]
        ids = np.full((m, beam), -1, np.int64)
        near = np.full((m, beam), -np.inf, np.float32)
        first = start[:, :beam]
        ids[:, : first.shape[1]] = first
        near[:, : first.shape[1]] = np.where(first >= 0, np.einsum("qmd,qd->qm", self.x[first], q), -np.inf)
        seen[rows, first] = True
        best = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
        fresh = ids >= 0
        links = self.links[lv]
        at_once = min(at_once, beam)
        live = np.arange(m)
        while len(live):
            f = fresh[live]
            live = live[f.any(axis=1)]
            if not len(live):
                break
            f = fresh[live]
            nxt = np.argsort(~f, axis=1, kind="stable")[:, :at_once]
            use = np.take_along_axis(f, nxt, 1)
            fresh[live[:, None], nxt] = False
            src = np.where(use, ids[live[:, None], nxt], -1)
            nb = np.where(src[:, :, None] >= 0, links[src], -1).reshape(len(live), -1)
            nb = np.sort(nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[live[:, None], nb]] = -1
            seen[live[:, None], nb] = True
            seen[:, n] = False  # where the -1 fall
            width = int((nb >= 0).sum(axis=1).max())
            if not width:
                continue
            nb = np.sort(nb, axis=1)[:, -width:]
            got = np.einsum("qmd,qd->qm", self.x[nb], q[live])
            got[nb < 0] = -np.inf
            all_ids = np.concatenate([ids[live], nb], axis=1)
            all_near = np.concatenate([near[live], got], axis=1)
            all_fresh = np.concatenate([fresh[live], nb >= 0], axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            near[live] = np.take_along_axis(all_near, best, 1)
            fresh[live] = np.take_along_axis(all_fresh, best, 1) & np.isfinite(near[live])
        return ids, near

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry)
        for lv in range(self.top, 0, -1):
            start, _ = self.walk(q, start, 4, lv)
        return self.walk(q, start, beam, 0, max(4, beam // 16))

    def audit(self, q: np.ndarray, own: np.ndarray | None, least: float, recall: float) -> tuple[int, int]:
        """Widen the beam until the queries' links are found; ``own`` are the nodes that the queries are. Returns links found and links there."""
        low = np.float32(least - 1e-4)
        truth = q @ self.x.T >= np.float32(least)
        if own is not None:
            truth[np.arange(len(q)), own] = False
        there = int(truth.sum())
        while there and self.beam < len(self.x):
            ids, near = self.nearest(q, self.beam)
            hit = np.zeros_like(truth)
            r, c = np.nonzero(near >= low)
            hit[r, ids[r, c]] = True
            # a query whose beam ends within the threshold is searched again, wider
            found = int(((hit | (near[:, -1] >= low)[:, None]) & truth).sum())
            if found >= recall * there:
                return found, there
            self.beam = min(len(self.x), 2 * self.beam)
        return there, there

    def within(self, q: np.ndarray, least: float, own: bool = False, audit_recall: float = 0.98):
        """Yields query rows and nodes whose cosine is ``least`` or more. With ``own`` the queries are the nodes themselves, in order."""
        n, low = len(self.x), np.float32(least - 1e-4)
        q32 = q.astype(np.float32)
        if own:
            some = np.random.default_rng(11).permutation(len(q))[:1024]
            for a in range(0, len(some), 64):
                part = some[a : a + 64]
                found, there = self.audit(q32[part], part, least, audit_recall)
                self.hit, self.truth = self.hit + found, self.truth + there
                if self.truth >= 100:
                    break
        else:
            found, there = self.audit(q32[::128], None, least, audit_recall)
            self.hit, self.truth = self.hit + found, self.truth + there
        at = 64 * 1024 * 1024 // max(1, n + 64 * self.beam) + 1
        todo, beam = np.arange(len(q)), self.beam
        while len(todo):
            more = []
            for a in range(0, len(todo), min(256, at)):
                part = todo[a : a + min(256, at)]
                if beam >= n:  # the beam is the whole shard
                    near = q32[part] @ self.x.T
                    ids = np.broadcast_to(np.arange(n), near.shape)
                else:
                    ids, near = self.nearest(q32[part], beam)
                    wide = near[:, -1] >= low
                    more.append(part[wide])
                    part, ids, near = part[~wide], ids[~wide], near[~wide]
                r, c = np.nonzero(near >= low)
                rows, nodes = part[r], ids[r, c]
                good = np.einsum("nd,nd->n", q[rows], self.exact[nodes]) >= least
                yield rows[good], nodes[good]
            todo = np.concatenate(more) if more else np.zeros(0, np.int64)
            beam = min(n, 4 * beam)


class Shard:
    """One shard's units: links among them, and to the units that stream by."""

    def __init__(self, units: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float):
        self.units, self.copies, self.least = units, copies, least
        self.graph = SmallWorld(unit_rows(vectors))
        self.links = np.zeros(len(units), np.int64)
        self.up = np.arange(len(units))

    def inner(self) -> None:
        """Links among the shard's own units; each may be found from both sides."""
        n, pairs = len(self.units), [np.zeros(0, np.int64)]
        for a, b in self.graph.within(self.graph.exact, self.least, own=True):
            a, b = a[a != b], b[a != b]
            pairs.append(np.unique(np.minimum(a, b) * n + np.maximum(a, b)))
            unite(self.up, a, b)
        pairs = np.unique(np.concatenate(pairs))
        a, b = pairs // n, pairs % n
        np.add.at(self.links, a, self.copies[b])
        np.add.at(self.links, b, self.copies[a])

    def outer(self, units: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        """Of other units: those that are linked, the vectors they are linked to, and a unit of this shard for each."""
        links = np.zeros(len(units), np.int64)
        first = np.full(len(units), -1, np.int64)
        for rows, nodes in self.graph.within(unit_rows(vectors), self.least):
            np.add.at(links, rows, self.copies[nodes])
            np.add.at(self.links, nodes, copies[rows])
            first[rows[::-1]] = nodes[::-1]
            unite(self.up, first[rows], nodes)
        said = np.flatnonzero(first >= 0)
        return units[said], links[said], self.units[first[said]]

    def said(self):
        """Of the shard's own units: those that are linked, the vectors they are linked to, and the roots of their trees."""
        up = roots(self.up)
        said = np.flatnonzero((self.links > 0) | (up != np.arange(len(up))))
        return self.units[said], self.links[said], self.units[up[said]]


#: What a row is to its task: a unit of its shard; one whose links among the shard another task counts; a unit to search for.
OWN, AGAIN, QUERY = range(3)


@task("embedding_dedup")
def _shards(batches, least: float):
    """Of rows task, label, kind, unit, copies, v sorted by task and kind: what the shards say, and as a row without unit what their audits found of what was there."""
    import pyarrow as pa

    now, label, held, shard = None, None, [], None

    def told(units, links, of):
        return pa.RecordBatch.from_arrays([pa.array([label] * len(units), pa.string()), pa.array(units, pa.int64()), pa.array(links, pa.int64()), pa.array(of, pa.int64())], names=["label", "unit", "links", "root"])

    def built():
        kind, units, copies, vectors = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(units)
        out = Shard(units[order], copies[order], vectors[order], least)
        if (kind == OWN).all():
            out.inner()
        held.clear()
        return out

    def done():
        if held or shard is not None:
            s = shard if shard is not None else built()
            yield told(*s.said())
            yield told([None], [s.graph.hit], [s.graph.truth])

    for batch in batches:
        names, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        kind, unit, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        values, off = batch.column(5).values.to_numpy(zero_copy_only=False), batch.column(5).offsets.to_numpy()
        codes = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = np.r_[0, np.flatnonzero((codes[1:] != codes[:-1]) | ((kind[1:] == QUERY) != (kind[:-1] == QUERY))) + 1, len(codes)] if len(codes) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if names[a] != now:
                yield from done()
                now, label, shard = names[a], labels[a], None
                held.clear()
            vectors = values[off[a] : off[z]].reshape(z - a, -1)
            if kind[a] == QUERY:
                shard = shard if shard is not None else built()
                yield told(*shard.outer(unit[a:z], copies[a:z], vectors))
            else:
                held.append((kind[a:z], unit[a:z], copies[a:z], vectors))
    yield from done()


def dealt(units: DataFrame, shard: int = SHARD, ahead: int = AHEAD) -> DataFrame:
    """Of ``label, v, unit, copies``: rows ``task, label, kind, unit, copies, v`` for the tasks; of each two shards one is searched in the other's graph."""
    units = units.withColumn("dim", F.size("v"))
    size = F.least(F.lit(shard), F.greatest(F.lit(64), F.floor(F.lit(SHARD_BYTES // 8) / F.col("dim"))))
    sizes = units.groupBy("label", "dim").agg(F.ceil(F.count("*") / size).cast("int").alias("k"))
    rows = units.join(sizes, ["label", "dim"]).withColumn("s", F.pmod(F.xxhash64("unit", F.lit(3)), F.col("k")).cast("int"))
    # to its own shard, in as many tasks as that takes, and as a query to the shards before it, half way round
    half = F.floor(F.col("k") / 2).cast("int")
    slices = F.greatest(F.lit(1), F.ceil(half / F.lit(ahead))).cast("int")
    own = F.transform(F.sequence(F.lit(0), slices - 1), lambda i: F.struct(F.col("s").alias("to"), i.alias("slice"), F.when(i == 0, OWN).otherwise(AGAIN).alias("kind")))
    far = F.when(half > 0, F.sequence(F.lit(1), half)).otherwise(F.array().cast("array<int>"))
    far = F.filter(far, lambda d: (d * 2 != F.col("k")) | (F.col("s") < d))  # half way, from one side only
    to_others = F.transform(far, lambda d: F.struct(F.pmod(F.col("s") - d, F.col("k")).cast("int").alias("to"), F.floor((d - 1) / F.lit(ahead)).cast("int").alias("slice"), F.lit(QUERY).alias("kind")))
    rows = rows.withColumn("t", F.explode(F.concat(own, to_others)))
    name = F.concat_ws("|", "label", "dim", "t.to", "t.slice")
    return rows.select(name.alias("task"), "label", F.col("t.kind").alias("kind"), "unit", "copies", "v")


def near_components(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, ahead: int = AHEAD) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): ``vec_id, n_links, component_id, kept``, and ``recall``: what the audits of
    the label's graphs found of the links there (1 if there were none; null without label)."""
    p = partitions(vectors.sparkSession)
    rows = narrowed(vectors, vec_id="bigint", embedding="array<double>", label="string")
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    fit = F.coalesce(fit & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # -0.0 and 0.0 are the same number
    rows = rows.withColumn("v", F.when(fit, F.transform("embedding", lambda v: v + F.lit(0.0)))).drop("embedding")
    units = cut(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("unit"), F.count("*").alias("copies")))
    said = cut(
        dealt(units, shard, ahead).repartition(p, "task").sortWithinPartitions("task", "kind")
        .mapInArrow(lambda it: _shards(it, least), schema(label="string", unit="bigint", links="bigint", root="bigint"))
    )
    found = said.where("unit is not null")
    audits = said.where("unit is null").groupBy("label").agg(F.coalesce(F.try_divide(F.sum("links"), F.sum("root")), F.lit(1.0)).alias("recall"))
    links = found.groupBy("unit").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("unit").alias("a"), F.col("root").alias("b")))
    by_unit = units.join(links, "unit", "left").join(groups.withColumnRenamed("node", "unit"), "unit", "left")
    by_unit = by_unit.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "unit").alias("c"))
    out = rows.join(by_unit, (rows["label"] == F.col("_l")) & (rows["v"] == F.col("_v")), "left").join(audits, "label", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "recall")
