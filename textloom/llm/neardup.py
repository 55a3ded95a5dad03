"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, column, components, durable, flat, mix, release, shingles, slices, summed, trimmed

WIDTH, SIMILAR = 5, 0.8
#: A pair of similarity s shares a band with 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8.
BANDS, ROWS = 12, 4
#: Document frequencies are kept for shingles hashed into so many buckets, over all documents (4 MB of weights broadcast, whatever the corpus).
DF_BITS, BLOCKS = 20, 64
#: Pairs whose samples agree on less than this share (over four standard deviations below SIMILAR) are not compared at first, only if they are still of different components at the end.
LEAST_ESTIMATE = 0.55
CHUNK, DOCS = 1 << 18, 4096
#: Pairs of different components of a cell are compared one by one while they are at most SMALL for each member; other cells in blocks of about so many members and bytes of text, all pairs of two blocks at once.
SMALL, BLOCK, BLOCK_BYTES = 8, 1024, 4 << 20
#: Shingles of two blocks that are added up pair by pair (of less than this share of all pairs), and values held at once.
SCARCE, HELD = 1 / 128, 1 << 21
#: Pairs of a file of compared pairs, and the least number of tasks that compare texts.
PAIRS, CORES = 1 << 13, 16
_ID = (1 << 52) - 1


def weighted(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 52-bit id and count of each distinct shingle of each text, sorted; at most DOCS texts."""
    h, of = shingles(raw, offs, WIDTH)
    key, n = np.unique((of.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)), return_counts=True)
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64(_ID), n


def idf_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight of each bucket of shingles, from all documents: 1 + log((N + 1) / (df + 1)) / log(N + 1), at least 1; N counts texts with shingles.

    This smooth form lies between 1 and 2, so one common group of copies can't lose its weight against its members' own words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "t", CHUNK, DOCS):
                of, ids, _ = weighted(*flat(column(part, "t")))
                n += len(np.unique(of))
                total += np.bincount((ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
        rows = [*total.reshape(BLOCKS, -1), np.array([n])]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["part", "block", "counts"])

    blocks = summed(docs.select(F.lower(F.col(text)).alias("t")).mapInArrow(lambda it: trimmed(count(it)), "part int, block int, counts binary"))
    if not blocks:
        return np.ones(1 << DF_BITS, np.float32)
    n = max(1, int(blocks[BLOCKS][0]))
    df = np.concatenate([blocks[k] for k in range(BLOCKS)])
    return np.maximum(1, 1 + np.log((n + 1) / (df + 1)) / np.log(n + 1)).astype(np.float32)


def _gamma2(n: int) -> np.ndarray:
    """Middle quantiles of Gamma(2, 1) in n equal shares."""
    x = np.geomspace(1e-6, 60, 200_001)
    return np.interp((np.arange(n) + 0.5) / n, -np.expm1(-x) - x * np.exp(-x), x)


class Sampler:
    """Improved consistent weighted sampling: r and c from Gamma(2, 1), beta uniform, by hash of shingle and sample number; t = floor(ln w / r + beta), and the shingle with the least ln c - r (t - beta + 1) is the sample.

    That least value itself stands for the pair of shingle and t, as it depends on nothing else.
    """

    def __init__(self) -> None:
        self.r, self.c = _gamma2(4096).astype(np.float32), np.log(_gamma2(65536)).astype(np.float32)
        seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)
        self.mul, self.add = seeds[::2] | np.uint32(1), seeds[1::2]

    def __call__(self, ids: np.ndarray, log_weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        lo, hi = ids.astype(np.uint32), (ids >> np.uint64(20)).astype(np.uint32)
        out = np.empty((len(first), BANDS * ROWS), np.float32)
        for k in range(BANDS * ROWS):
            x = lo * self.mul[k] ^ (hi + self.add[k])
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            x ^= x >> np.uint32(16)
            r = self.r[x & np.uint32(4095)]
            beta = ((x * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_weight / r + beta)
            out[:, k] = np.minimum.reduceat(self.c[x >> np.uint32(16)] - r * (t - beta + np.float32(1)), first)
        return out


def signatures(docs: DataFrame, weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th (hash of the text), c1, c2 (hash of the counted shingles), samples (array<int>, the bits of floats) and bands (array<long>) of each text that has words. weights: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sample = np.log(weights.value), Sampler()
        salt = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "t", CHUNK, DOCS):
                of, ids, n = weighted(*flat(column(part, "t")))
                if not len(of):
                    continue
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                got = sample(ids, np.log(n).astype(np.float32) + idf[(ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)], first)
                bits = got.view(np.uint32).astype(np.uint64).reshape(len(first), BANDS, ROWS)
                acc = np.broadcast_to(salt, (len(first), BANDS)).copy()
                for k in range(ROWS):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
                each = mix(ids + np.uint64(1)) * n.astype(np.uint64)
                c1, c2 = np.add.reduceat(each, first), np.add.reduceat(mix(each), first)
                rows = pa.array(of[first])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (got.view(np.int32), acc.view(np.int64))]
                yield pa.RecordBatch.from_arrays([column(part, "id").take(rows), column(part, "th").take(rows), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), *lists], names=["id", "th", "c1", "c2", "samples", "bands"])

    src = _texts(docs, key, text).where("id is not null").select("id", F.xxhash64("t").alias("th"), "t")
    return src.mapInArrow(lambda it: trimmed(run(it)), "id long, th long, c1 long, c2 long, samples array<int>, bands array<long>")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.lower(F.col(text)).alias("t"))


def _estimate(pairs: DataFrame) -> DataFrame:
    """m, a, b and est, the share of samples on which a pair agrees, of rows m, a, b, sa, sb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (column(batch, k).flatten().to_numpy().reshape(len(batch), -1) for k in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in "mab"), pa.array((a == b).mean(axis=1))], names=["m", "a", "b", "est"])

    return pairs.select("m", "a", "b", "sa", "sb").mapInArrow(run, "m long, a long, b long, est double")


def _verify(pairs: DataFrame, weights) -> DataFrame:
    """a, b, similar (weighted Jaccard) of rows a, b, ta, tb. weights: a broadcast."""

    def sets(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, ids, n = weighted(*flat(texts))
        w = n * idf[(ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)].astype(np.float64)
        return (of.astype(np.uint64) << np.uint64(52)) | ids, w, np.bincount(of, weights=w, minlength=len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        for batch in batches:
            for part in (y for x in slices(batch, "ta", CHUNK, 512) for y in slices(x, "tb", CHUNK, 512)):
                (ka, wa, sa), (kb, wb, sb) = (sets(column(part, k), idf) for k in ("ta", "tb"))
                both, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                low = np.bincount((both >> np.uint64(52)).astype(np.int64), weights=np.minimum(wa[x], wb[y]), minlength=len(part))
                yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b"), pa.array(low / np.maximum(sa + sb - low, 1e-12))], names=["a", "b", "similar"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(lambda it: trimmed(run(it)), "a long, b long, similar double")


def _central(members: DataFrame, *more: str) -> DataFrame:
    """cell and p, the member of each cell that shares most cells with others, and of these the least, and more of its columns after a p; a partially aggregated maximum, whatever a cell's size."""
    best = members.groupBy("cell").agg(F.max(F.struct("central", (-F.col("rep")).alias("r"), *more)).alias("x"))
    return best.select("cell", (-F.col("x.r")).alias("p"), *(F.col(f"x.{c}").alias(f"p{c}") for c in more))


def shared_weights(texts: pa.Array, left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each left text with each right one (places in texts), exact: a shingle that occurs n times is n features, each there or not, so that products of zeros and ones add up the lesser weights."""
    of, ids, n = weighted(*flat(texts))
    w = idf[(ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)].astype(np.float64)
    total = np.bincount(of, weights=n * w, minlength=len(texts))
    at = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(at)) - (np.cumsum(n) - n)[at]
    _, shingle = np.unique(ids, return_inverse=True)
    key, first, feature = np.unique(shingle[at] * int(n.max(initial=1)) + nth, return_index=True, return_inverse=True)
    weight, of = w[at][first], of[at]
    sides = []
    for side in (left, right):
        place = np.full(len(texts), -1)
        place[side] = np.arange(len(side))
        here = np.flatnonzero(place[of] >= 0)
        here = here[np.argsort(feature[here], kind="stable")]
        sides.append((feature[here], place[of[here]], np.bincount(feature[here], minlength=len(key))))
    (fa, a, na), (fb, b, nb) = sides
    low = np.zeros(len(left) * len(right))
    both = na * nb
    scarce = (both > 0) & (both <= SCARCE * len(low))
    own = np.flatnonzero(scarce[fa])
    m, head = nb[fa[own]], (np.cumsum(nb) - nb)[fa[own]]
    ends = np.cumsum(m)
    j = 0
    while j < len(own):  # each left occurrence beside all right ones
        to = max(j + 1, int(np.searchsorted(ends, (ends[j - 1] if j else 0) + HELD, side="right")))
        k = m[j:to]
        row = np.repeat(own[j:to], k)
        other = np.repeat(head[j:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        low += np.bincount(a[row] * len(right) + b[other], weights=weight[fa[row]], minlength=len(low))
        j = to
    low = low.reshape(len(left), len(right))
    rest = np.flatnonzero((both > 0) & ~scarce)
    width = max(1, HELD // max(len(left), len(right), 1))
    number = np.full(len(key), -1)
    for j in range(0, len(rest), width):
        some = rest[j : j + width]
        number[:] = -1
        number[some] = np.arange(len(some))
        x, y = np.zeros((len(left), len(some))), np.zeros((len(right), len(some)))
        ka, kb = number[fa] >= 0, number[fb] >= 0
        x[a[ka], number[fa[ka]]] = weight[fa[ka]]
        y[b[kb], number[fb[kb]]] = 1
        low += x @ y.T
    return low / np.maximum(total[left][:, None] + total[right][None] - low, 1e-12)


def _all_pairs(members: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """a, b of every pair of one cell and of different components with similarity >= least, of rows cell, rep, comp, main (the cell's largest component): no pair is left out, by samples or otherwise.

    Members of a cell are dealt to blocks, those of its largest component to blocks of their own, which are not compared with one another; each two blocks meet in a group of their own.
    """

    def compare(table: pa.Table) -> pa.Table:
        rep, comp, blk = (table[c].to_numpy() for c in ("rep", "comp", "blk"))
        left, right = np.flatnonzero(blk == blk.min()), np.flatnonzero(blk == blk.max())
        if table["lo"][0].as_py() < table["hi"][0].as_py() and blk.min() == blk.max():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        near = shared_weights(table["t"].combine_chunks(), left, right, weights.value) >= least
        x, y = np.nonzero(near & (comp[left][:, None] != comp[right][None]))
        x, y = rep[left[x]], rep[right[y]]
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    rows = members.select("cell", "rep", "comp", (F.col("comp") == F.col("main")).alias("own")).join(texts, "rep")
    size = F.sum(F.octet_length("t"))
    blocks = rows.groupBy("cell", "own").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int").alias("n"))
    blocks = blocks.groupBy("cell").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n_own"), F.max(F.when(~F.col("own"), F.col("n"))).alias("n_other"))
    place = F.xxhash64("rep", F.lit(5))
    dealt = rows.join(blocks, "cell").withColumn("blk", F.when(F.col("own"), F.pmod(place, "n_own")).otherwise(F.col("n_own") + F.pmod(place, "n_other")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.when(F.col("own"), F.col("n_own")).otherwise(0), F.col("n_own") + F.col("n_other") - 1)))
    dealt = dealt.select("cell", F.least("blk", "with").alias("lo"), F.greatest("blk", "with").alias("hi"), "rep", "comp", "blk", "t")
    return dealt.groupBy("cell", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id and class_id (least doc_id of its group) of every distinct non-null key.

    Words are runs of letters and digits of the lower-case text; a text of fewer than WIDTH words has one shingle of all, a text without words (null, empty) is in a class of its own; long texts are handled whole.
    Texts with equal counted shingles are one class from the start, so copies cost one row each. An empty table gives no rows.
    Repeated rows of a key count once; if they hold different texts, the one with the least hash stands. Other columns are not read, so they may have any names.

    Between classes, documents that share a band's cell are candidates. First each document is compared with the most central member of one of its cells, the most promising by samples. Then cells that still span several components
    are finished: by all pairs of different components one by one where these are few a member, whatever their samples say. Other cells are compared with their most central member, and if they still span several components, all pairs of different components are compared in blocks,
    whatever their number: no partner is ever capped, and every pair of a shared cell either is compared or is in one class already. A cell of n members of few likenesses so costs up to n * n / 2 comparisons, by products of matrices.
    Samples only choose which pairs come first: no pair of a cell is taken for different by them.
    Every link is verified: weighted Jaccard similarity of the TF-IDF shingles >= least.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    weights = spark.sparkContext.broadcast(idf_weights(docs, text))
    raw = signatures(docs, weights, key, text)
    sig = durable(raw.groupBy("id").agg(F.min_by(F.struct(*(c for c in raw.columns if c != "id")), "th").alias("s")).select("id", "s.*"), "sig")
    same = sig.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    cells = sig.join(same.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), F.posexplode("bands").alias("band", "cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    cells = durable(cells.join(shared, "cell"), "cells")
    named = cells.groupBy("rep").agg(F.sum("size").alias("central"))
    samples = durable(sig.join(named, sig["id"] == named["rep"]).select("rep", "th", "samples", "central"), "samples")
    own = _texts(docs, key, text).withColumn("th", F.xxhash64("t")).hint("merge").join(samples.select(F.col("rep").alias("id"), "th"), ["id", "th"], "left_semi")
    texts = durable(own.dropDuplicates(["id", "th"]).select(F.col("id").alias("rep"), "t"), "texts")  # the join has dealt them by both
    members = cells.select("cell", "band", "rep").join(samples.select("rep", "central"), "rep")
    bar = min(LEAST_ESTIMATE, least - 0.25)
    written: list[DataFrame] = []
    tested: list[DataFrame] = []
    links: list[DataFrame] = []
    labels = None

    def promising(pairs: DataFrame, rows: int) -> DataFrame:
        """a, b: of the pairs m, a, b of each m the one whose samples agree most, if these agree on LEAST_ESTIMATE of all. rows: about how many pairs there are, which tables are sized by."""
        for k in "ab":
            pairs = pairs.join(samples.select(F.col("rep").alias(k), F.col("samples").alias(f"s{k}")), k)
        est = durable(_estimate(pairs).coalesce(max(1, rows // PAIRS)), "est")
        written.append(est)
        return est.where(F.col("est") >= bar).groupBy("m").agg(F.max(F.struct("est", "a", "b")).alias("x")).select("x.a", "x.b").distinct()

    def compared(pairs: DataFrame, rows: int) -> None:
        """Compare the texts of all pairs a, b of a < b that were not compared before. New links give new labels. rows: as above."""
        nonlocal labels
        if tested:
            pairs = pairs.join(functools.reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        for k in "ab":
            pairs = pairs.join(texts.select(F.col("rep").alias(k), F.col("t").alias(f"t{k}")), k)
        seen = durable(_verify(pairs, weights).coalesce(max(1, rows // PAIRS, CORES)), "seen")
        written.append(seen)
        tested.append(seen.select("a", "b"))
        new = seen.where(F.col("similar") >= least).select("a", "b")
        links.append(new)
        if labels is None or not new.isEmpty():
            was, labels = labels, components(functools.reduce(DataFrame.union, links), "labels")
            release(was)

    pivots = _central(members)
    first = members.join(pivots, "cell").where("rep <> p").select(F.col("rep").alias("m"), F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
    room = cells.count()
    compared(promising(first, room), room)

    def spanning(members: DataFrame) -> DataFrame:
        """cell, band, rep, central, comp, main, share and few of the members of cells that span several components."""
        named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cell", "band", "rep", "central", F.coalesce("component", "rep").alias("comp"))
        sizes = named.groupBy("cell", "comp").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("own"))
        apart = (F.col("n").cast("double") ** 2 - F.col("own")) / 2
        spans = sizes.where("main.n < n").select("cell", F.col("main.comp").alias("main"), (apart / F.col("n")).alias("share"), (apart <= SMALL * F.col("n")).alias("few"))
        return durable(named.join(spans, "cell"), "open")

    still = spanning(members)
    rows, left = still.agg(F.count("*"), F.sum("share")).collect()[0]
    if rows:
        # not more than a pair for each membership there was: all at once
        few, many = (still, still.limit(0)) if left <= room else (still.where("few"), still.where("not few"))
        other = few.where("comp <> main").select("cell", F.col("rep").alias("p"), F.col("comp").alias("pcomp"))
        pairs = few.join(other, "cell").where("comp <> pcomp and (comp = main or rep < p)").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
        stars = many.join(_central(many, "comp"), "cell").where("comp <> pcomp").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
        compared(pairs.union(stars).distinct(), rows * SMALL)
        if left > room:
            rest = spanning(many.select("cell", "band", "rep", "central"))
            more = durable(_all_pairs(rest, texts, weights, least), "pairs")
            if not more.isEmpty():
                links.append(more)
                was, labels = labels, components(functools.reduce(DataFrame.union, links), "labels")
                release(was)
            written.extend((rest, more))
    written.append(still)
    release(cells, texts, samples, *written)
    member = sig.select("id", "c1", "c2").join(same, ["c1", "c2"]).join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    every = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id")).distinct()
    return every.join(member.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the least id of each group of near copies."""
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
