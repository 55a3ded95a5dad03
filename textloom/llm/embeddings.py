"""Embedding near-dedup: shards of near vectors, hierarchical navigable small-world graphs per shard, beams widened until recall audits pass, double-precision cosine, union of components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import column, components, durable, mix, release, summed

SIMILAR = 0.95
#: Vectors of a shard's graph, the least number of shards, query vectors of a task, and those searched at once.
SHARD, LEAST_SHARDS, QUERIES, AT_ONCE = 4096, 8, 65536, 2048
#: Neighbours on the lowest level and above, candidates when a node is inserted.
M0, M, EF_BUILD = 32, 12, 64
#: First beam, widest beam (a query whose beam is still full of links then scans its shard), and the recall that an audit asks for.
EF, EF_MOST, RECALL = 48, 96, 0.995
#: Vectors of a shard that an audit turns away to exactly SIMILAR and looks for, and query vectors that it compares with the whole shard.
AUDIT, AUDITED = 128, 1024
#: Values of the sample on which the shards' centres are fitted (every vector is placed and searched), and at least so many vectors a centre.
FIT, FIT_EACH = 1 << 20, 32
#: Vectors whose links among all rows, and vectors whose turned copies, decide how far from the nearest centre a query asks; the share of links it must reach; steps of a cosine; cosines held at once.
ROUTES, TURNED, REACHED, STEPS, HELD = 256, 4096, 0.998, 128, 1 << 22


class Graph:
    """Nodes are inserted in doubling batches: each batch searches the graph so far and itself, keeps diverse neighbours, and is linked back."""

    def __init__(self, x: np.ndarray, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(rng.random(n)) / np.log(M)).astype(int), 6) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # high nodes first, so every level is complete when it is walked
        self.nbr = [np.full((n, M0 if k == 0 else M), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        at = 0
        while at < n:
            batch = order[at : at + min(max(at, 256), 1024)]
            for k in range(len(self.nbr)):
                part = batch[level[batch] >= k]
                if len(part):
                    self._insert(part, order[:at][level[order[:at]] >= k], k)
            at += len(batch)

    def _insert(self, part: np.ndarray, there: np.ndarray, k: int) -> None:
        own = self.x[part] @ self.x[part].T
        np.fill_diagonal(own, -2)
        top = min(EF_BUILD // 2, len(part) - 1)
        near = np.argpartition(-own, top - 1, axis=1)[:, :top] if top > 0 else np.zeros((len(part), 0), int)
        cand, sim = part[near], np.take_along_axis(own, near, 1)
        if len(there):
            found, s = self.search(self.x[part], EF_BUILD, k)
            cand, sim = np.concatenate([cand, found], 1), np.concatenate([sim, s], 1)
        chosen = self._diverse(part, cand, sim, self.nbr[k].shape[1])
        self.nbr[k][part] = chosen
        # links back
        a, b = np.repeat(part, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        if not len(a):
            return
        s = np.einsum("ij,ij->i", self.x[a], self.x[b])
        o = np.lexsort((-s, b))
        a, b = a[o], b[o]
        node, first, size = np.unique(b, return_index=True, return_counts=True)
        rank = np.arange(len(b)) - np.repeat(first, size)
        few = rank < 2 * self.nbr[k].shape[1]
        extra = np.full((len(node), int(min(size.max(), 2 * self.nbr[k].shape[1]))), -1, np.int32)
        extra[np.repeat(np.arange(len(node)), size)[few], rank[few]] = a[few]
        for j in range(0, len(node), 512):
            some = node[j : j + 512]
            cand = np.concatenate([self.nbr[k][some], extra[j : j + 512]], 1)
            sim = np.where(cand >= 0, np.matmul(self.x[cand], self.x[some][:, :, None])[:, :, 0], -2)
            self.nbr[k][some] = self._diverse(some, cand, sim, self.nbr[k].shape[1])

    def _diverse(self, part: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, those closer to the node than to any chosen one; then the best of the rest, until `most`."""
        out = np.full((len(part), most), -1, np.int32)
        for j in range(0, len(part), 512):
            c, s = cand[j : j + 512], sim[j : j + 512]
            s = np.where((c >= 0) & (c != part[j : j + 512, None]), s, -2)
            o = np.argsort(-s, axis=1, kind="stable")[:, : 2 * most]
            c, s = np.take_along_axis(c, o, 1), np.take_along_axis(s, o, 1)
            same = np.zeros(c.shape, bool)
            by_id = np.argsort(c, axis=1, kind="stable")
            sorted_c = np.take_along_axis(c, by_id, 1)
            np.put_along_axis(same, by_id, np.c_[np.zeros(len(c), bool), sorted_c[:, 1:] == sorted_c[:, :-1]], 1)
            s[same] = -2
            y = self.x[np.maximum(c, 0)]
            pair = np.matmul(y, y.transpose(0, 2, 1))
            taken = np.zeros(c.shape, bool)
            for i in range(c.shape[1]):
                close = np.where(taken, pair[:, i], -2).max(axis=1)
                taken[:, i] = (s[:, i] > -2) & (close < s[:, i]) & (taken.sum(axis=1) < most)
            score = np.where(s > -2, s + 4.0 * taken, -9)
            o = np.argsort(-score, axis=1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(score, o, 1) > -3, np.take_along_axis(c, o, 1), -1)
            out[j : j + len(c), : got.shape[1]] = got
        return out

    def search(self, q: np.ndarray, ef: int, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the ef nearest nodes found on level `stop` (padded by -1), and their cosines, in no order."""
        n = len(self.x)
        width = max(1, min(len(q), (24 << 20) // max(n, 1), 1024))
        parts = [self._search(q[j : j + width], ef, stop) for j in range(0, len(q), width)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, ef: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry)
        best = q @ self.x[self.entry]
        for k in range(len(self.nbr) - 1, stop, -1):
            live = np.arange(len(q))
            while len(live):
                nb = self.nbr[k][at[live]]
                s = np.where(nb >= 0, np.matmul(self.x[nb], q[live][:, :, None])[:, :, 0], -2)
                j = s.argmax(axis=1)
                top = s[np.arange(len(live)), j]
                up = top > best[live]
                live, nb, j, top = live[up], nb[up], j[up], top[up]
                at[live], best[live] = nb[np.arange(len(live)), j], top
        wide = 4 if ef <= 128 else 16
        ids = np.full((len(q), ef), -1, np.int32)
        sim = np.full((len(q), ef), -2, np.float32)
        todo = np.zeros((len(q), ef), bool)
        ids[:, 0], sim[:, 0], todo[:, 0] = at, best, True
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[np.arange(len(q)), at] = True
        live = np.arange(len(q))
        nbr = self.nbr[stop]
        while len(live):
            score = np.where(todo[live], sim[live], -9)
            pick = np.argpartition(-score, min(wide, ef) - 1, axis=1)[:, : min(wide, ef)]
            ok = np.take_along_axis(score, pick, 1) > -9
            go = ok.any(axis=1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            todo[live[:, None], pick] = False
            nb = np.where(ok[:, :, None], nbr[np.where(ok, ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            nb.sort(axis=1)
            new = nb >= 0
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            new &= ~seen[live[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(new)
            node = nb[r, c]
            seen[live[r], node] = True
            s = np.full(nb.shape, -2, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.x[node], q[live[r]])
            all_s = np.concatenate([sim[live], s], 1)
            keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sim[live] = np.take_along_axis(all_s, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(s > -2, nb, -1)], 1), keep, 1)
            todo[live] = np.take_along_axis(np.concatenate([todo[live], s > -2], 1), keep, 1)
        return ids, sim


def links(graph: Graph, x: np.ndarray, q: np.ndarray, ef: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and node of every pair found with cosine >= least; x and q are unit vectors in double precision. Beams that are full of links are widened, at last to the whole shard."""
    near = least - 1e-5  # beams compare in single precision, links in double
    todo, got = np.arange(len(q)), []
    q32 = q.astype(np.float32)
    while len(todo):
        if ef > EF_MOST or ef >= len(x):
            for j in range(0, len(todo), 256):
                r, c = np.nonzero(q[todo[j : j + 256]] @ x.T >= near)
                got.append((todo[j : j + 256][r], c))
            break
        ids, sim = graph.search(q32[todo], ef)
        full = (sim >= near).all(axis=1)
        r, c = np.nonzero((sim >= near) & ~full[:, None])
        got.append((todo[r], ids[r, c]))
        todo, ef = todo[full], ef * 4
    a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
    ok = np.concatenate([np.einsum("ij,ij->i", q[a[j : j + 65536]], x[b[j : j + 65536]]) >= least for j in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
    return a[ok], b[ok]


def _turned(x: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """Unit vectors at that cosine from each row of x, in random directions."""
    if x.shape[1] == 1:
        return x
    noise = np.random.default_rng(seed).standard_normal(x.shape)
    noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    return cosine * x + np.sqrt(1 - cosine**2) * noise


def beam(graph: Graph, x: np.ndarray, q: np.ndarray, least: float) -> int:
    """The least beam that finds RECALL of the true links of these queries and of shard vectors turned away to a cosine of `least`."""
    probe = np.concatenate([q, _turned(x[np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int)], least + 1e-6, 7)])
    true = sum(int((probe[j : j + 256] @ x.T >= least).sum()) for j in range(0, len(probe), 256))
    ef = EF
    while ef < len(x) and len(links(graph, x, probe, ef, least)[0]) < RECALL * true:
        ef *= 2
    return ef


def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    step = max(1, HELD // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *((x[j : j + step].astype(np.float32) @ centres.T).argmax(axis=1) for j in range(0, len(x), step))])


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centres of unit vectors (single precision)."""
    c = x[np.random.default_rng(2).choice(len(x), k, replace=False)]
    for _ in range(8):
        total = np.zeros_like(c)
        np.add.at(total, _home(x, c), x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-6, total / np.maximum(norm, 1e-6)[:, None], c)
    return c


def _short_of(q: np.ndarray, centres: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """By how much each centre's cosine, or the one of the centre `at`, falls short of the nearest centre's, in steps."""
    s = q.astype(np.float32) @ centres.T
    of = s if at is None else np.take_along_axis(s, at[:, None], 1)
    short = np.minimum(np.ceil((s.max(axis=1)[:, None] - of) * STEPS), 2 * STEPS).astype(np.int32)
    return short if at is None else short[:, 0]


def _routed(classes: DataFrame, dim: int, n: int, least: float) -> DataFrame:
    """dim, rep, copies, v, shard and asks (the shards that may hold links of it) of the n classes of vectors of this length.

    Every vector belongs to its nearest centre, and centres with more than SHARD vectors have several shards. A query asks the shards of all centres whose cosine falls short of its nearest one's by a margin at most.
    A link is reached if either end asks the other's shard. The margin is the least with which REACHED of all links are: links of ROUTES vectors with all rows (by brute force; each such vector counting once, and each link once)
    and of TURNED vectors turned away to exactly `least`.
    """
    part = classes.where(F.size("v") == dim).select(F.lit(dim).alias("dim"), "rep", "copies", "v")
    k = max(-(-n // SHARD), min(LEAST_SHARDS, n // FIT_EACH))
    if k <= 1:
        return part.select("*", F.lit(0).alias("shard"), F.array(F.lit(0)).alias("asks"))
    share = min(1.0, max(FIT // dim, FIT_EACH * k, 1024) / n)
    sample = part.where(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64("rep", F.lit(12)).alias("h"), "v").toArrow().sort_by("h")
    x = _matrix(sample["v"])
    centres = _centres(x.astype(np.float32), min(k, len(x)))
    some, near = x[:ROUTES], x[:TURNED]
    shorts, homes = _short_of(some, centres), _home(some, centres)
    bins, spark = 2 * STEPS + 1, classes.sparkSession
    shared = spark.sparkContext.broadcast((centres, some, shorts, homes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, q, short, own = shared.value
        found, sizes = np.zeros(len(q) * bins, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            if len(batch):
                y = _matrix(column(batch, "v"))
                home = _home(y, c)
                sizes += np.bincount(home, minlength=len(c))
                a, b = np.nonzero(q @ y.T >= least)
                for j in range(0, len(a), step := max(1, HELD // len(c))):
                    m, n = a[j : j + step], b[j : j + step]
                    found += np.bincount(m * bins + np.minimum(short[m, home[n]], _short_of(y[n], c, own[m])), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array([found.tobytes(), sizes.tobytes()], pa.binary())], names=["part", "block", "counts"])

    got = summed(part.select("v").mapInArrow(count, "part int, block int, counts binary"))
    found = got[0].reshape(len(some), bins)
    away = _turned(near, least + 1e-6, 9)
    turned = np.concatenate([np.minimum(_short_of(x, centres, _home(y, centres)), _short_of(y, centres, _home(x, centres))) for x, y in ((near[j : j + 256], away[j : j + 256]) for j in range(0, len(near), 256))])
    each = (found / np.maximum(found.sum(axis=1), 1)[:, None])[found.sum(axis=1) > 1]
    reached = [np.cumsum(h) / max(h.sum(), 1e-12) for h in (found.sum(axis=0), each.sum(axis=0), np.bincount(turned, minlength=bins)) if h.sum()]
    margin = max(int(np.searchsorted(r, REACHED)) for r in reached)
    subs = np.maximum(-(-got[1] // SHARD), 1)
    first = np.cumsum(subs) - subs

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value[0]
        step = max(1, HELD // len(c))
        for batch in (whole.slice(j, step) for whole in batches for j in range(0, len(whole), step)):
            y = _matrix(column(batch, "v"))
            home, rep = _home(y, c), column(batch, "rep").to_numpy()
            row, cell = np.nonzero(_short_of(y, c) <= margin)
            m = subs[cell]
            at = np.repeat(np.arange(len(m)), m)
            asks = first[cell][at] + np.arange(m.sum()) - (np.cumsum(m) - m)[at]
            offs = np.searchsorted(row[at], np.arange(len(batch) + 1)).astype(np.int32)
            shard = first[home] + (mix(rep.astype(np.uint64)) % subs[home].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(batch, f) for f in ("dim", "rep", "copies", "v")), pa.array(shard.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(asks.astype(np.int32)))], names=["dim", "rep", "copies", "v", "shard", "asks"])

    return part.mapInArrow(place, f"dim int, rep long, copies long, v {part.schema['v'].dataType.simpleString()}, shard int, asks array<int>")


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    one = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = one.flatten().to_numpy().astype(np.float64).reshape(len(one), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", least: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id of every distinct non-null key.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different lengths never link. Equal vectors are one node with a count;
    of rows that repeat a key the first by value stands for it. Shards and graphs are approximate: audits against brute force hold the choice of shards to REACHED and each task to RECALL; all links returned have cosine >= least in double precision.
    Each vector goes to the shards near it only, so the work grows less than with the square. Pairs stay inside tasks, which return counts and the edges of a spanning forest. Other columns are not read.
    """
    kind = vectors.schema[vec].dataType.simpleString()
    plain = F.col(vec) if kind == "array<float>" else F.transform(vec, lambda v: v.cast("double"))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), plain.alias("v"))
    rows = durable(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    good = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite).where((norm > 0) & (norm < float("inf")))
    classes = durable(good.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "v"), "classes")
    member = good.join(classes.select("v", "rep", "copies"), "v").select("id", "rep", "copies")
    dims = sorted(tuple(r) for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*")).collect()) or [(0, 0)]
    placed = durable(functools.reduce(DataFrame.union, (_routed(classes, *d, least) for d in dims)), "placed")

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            left = left.sort_by("rep")
            x, nodes, copies = _matrix(left["v"]), left["rep"].to_numpy(), left["copies"].to_numpy()
            graph, ids, times, homes = Graph(x), right["rep"].to_numpy(), right["copies"].to_numpy(), right["home"].to_numpy().astype(np.int64)
            asked = left["asks"].combine_chunks()
            wide = 1 + max(int(homes.max()), int(np.max(asked.flatten().to_numpy())))
            back = np.sort(np.repeat(np.arange(len(nodes)), np.diff(asked.offsets.to_numpy())) * wide + asked.flatten().to_numpy())  # what each node asks itself
            audit = np.flatnonzero(ids % 20 == 0)[:AUDITED]
            ef = beam(graph, x, _matrix(right["v"].take(pa.array(audit))) if len(audit) else x[:0], least)
            for j in range(0, len(ids), AT_ONCE):
                a, b = links(graph, x, _matrix(right["v"].slice(j, AT_ONCE)), ef, least)
                a = a + j
                other = ids[a] != nodes[b]
                a, b = a[other], b[other]
                place = b * wide + homes[a]
                lone = back[np.minimum(np.searchsorted(back, place), len(back) - 1)] != place  # only this end asks the other's shard
                low, high = _forest(ids[a], nodes[b])
                for ends, n in ((ids[j : j + AT_ONCE], np.bincount(a - j, weights=copies[b], minlength=len(ids[j : j + AT_ONCE]))), (nodes, np.bincount(b[lone], weights=times[a[lone]], minlength=len(nodes)))):
                    some = np.flatnonzero(n)
                    out.append(pa.table({"a": pa.array(ends[some], pa.int64()), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(n[some].astype(np.int64), pa.int64())}))
                out.append(pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64()), "n": pa.nulls(len(low), pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in "abn"})

    q = placed.select("dim", "rep", "copies", "v", F.col("shard").alias("home"), F.explode("asks").alias("shard"))
    groups = durable(placed.select("dim", F.explode("asks").alias("shard")).groupBy("dim", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "groups")
    q = q.join(F.broadcast(groups), ["dim", "shard"]).withColumn("q", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("groups")).cast("int")).drop("groups")
    again = vectors.sparkSession.read.schema(placed.schema).parquet(placed._durable_path)  # a table of its own, so that no column is ambiguous
    x = again.join(F.broadcast(groups), ["dim", "shard"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    tasks = 4 * (groups.agg(F.sum("groups")).collect()[0][0] or 1)  # a few bytes are much work here, so partitions by their bytes would be too few; most of these hold one group or none
    x, q = (t.repartition(tasks, "dim", "shard", "q") for t in (x, q))
    got = durable(x.groupBy("dim", "shard", "q").cogroup(q.groupBy("dim", "shard", "q")).applyInArrow(ask, "a long, b long, n long"), "found")
    labels = components(got.where("b is not null").select("a", "b"), "vec")
    release(placed, groups)
    counts = got.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    info = member.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return rows.select("id").join(info, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a component of a, b to its least member."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def op9_embedding_near_duplicates(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_duplicates(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))
