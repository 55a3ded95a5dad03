"""Shared pieces of the training-data operators: durable tables, byte views of Arrow texts, word hashes, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []
#: Bytes and rows of an Arrow batch between the JVM and Python: whole rows, so a longer text is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that a worker's memory does not follow the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if everything runs in this process (tests), else an error: no machine-local folder outlives an executor."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again. Survives lost executors; release() deletes it before the session ends."""
    path = f"{shared_dir(df.sparkSession)}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame | None) -> None:
    """Delete durable tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_durable_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


@atexit.register
def _drop_written() -> None:
    spark = SparkSession._instantiatedSession
    if spark is None:
        return
    for path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already; leftovers lie in the checkpoint folder
            return


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when they end, freed memory goes back to the system, for workers live on from task to task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


# ---- Arrow texts as bytes -------------------------------------------------------------------------------------------


def column(batch: pa.RecordBatch, name: str | int) -> pa.Array:
    """A column by name, or by place (from the end if negative), where the names of other columns are the caller's."""
    return batch.column(batch.schema.get_field_index(name) if isinstance(name, str) else name % batch.num_columns)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n+1 offsets into it. A null counts as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def free(stem: str, *taken: str) -> str:
    """A column name like stem that none of the taken ones equals, in any case."""
    low = {t.lower() for t in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


def slices(batch: pa.RecordBatch, name: str | int, most: int, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most that many rows and bytes of text, or one row."""
    texts = column(batch, name)
    _, offs = flat(texts)
    at, n = 0, len(texts)
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
#: Places hashed at once; longer inputs are taken in ranges.
HASHED = 1 << 20


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= HASHED."""
    out = []
    for b in (_BASE, _INV):
        x = np.full(HASHED + 1, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] times base**-s a polynomial hash of raw[s:e], modulo 2**64; at most HASHED bytes. Equal hashes do not prove equal bytes: compare these where a result rests on them."""
    out = np.zeros(len(raw) + 1, np.uint64)
    pw, _ = _powers()
    np.cumsum((raw.astype(np.uint64) + np.uint64(0x51ED27)) * pw[: len(raw)], out=out[1:])
    return out


def range_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[s:e], the same wherever the bytes lie."""
    _, inv = _powers()
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """range_hash of ascending, disjoint ranges of any length, in pieces of at most HASHED bytes; what lies beyond HASHED bytes of one range joins its hash piece by piece."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + HASHED, side="right")))
        if ends[at] - base > HASHED:
            acc = np.zeros(1, np.uint64)
            for k in range(base, int(ends[at]), HASHED):
                pre = prefix_hash(raw[k : min(k + HASHED, int(ends[at]))])
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + range_hash(pre, np.array([0]), np.array([len(pre) - 1])))
            out[at], at = acc[0], at + 1
            continue
        pre = prefix_hash(raw[base : ends[to - 1]])
        out[at:to] = range_hash(pre, starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """For each row, whether a[a_start:+size] and b[b_start:+size] are the same bytes."""
    out = np.ones(len(size), bool)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        if size[at] > most:
            s, t, n = int(a_start[at]), int(b_start[at]), int(size[at])
            out[at], at = np.array_equal(a[s : s + n], b[t : t + n]), at + 1
            continue
        n = size[at:to]
        step = np.arange(total[to - 1] - done) - np.repeat(total[at:to] - done - n, n)
        bad = a[step + np.repeat(a_start[at:to], n)] != b[step + np.repeat(b_start[at:to], n)]
        out[at:to] = np.bincount(np.repeat(np.arange(to - at), n)[bad], minlength=to - at) == 0
        at = to
    return out


#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def words(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of such bytes that don't cross a text's border, and the index of the first run of each text (n+1)."""
    inside = kind[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offs)


def shingles(raw: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each text, repeats included, and the text of each. A text of fewer words has one shingle of all of them, a text without words none."""
    starts, ends, first = words(raw, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = run_hashes(raw, starts, ends)
    count = np.diff(first)
    n = len(h)
    acc = np.zeros(n, np.uint64)
    left = np.repeat(first[1:], count) - np.arange(n)  # words from here to the text's end
    for k in range(width):
        term = np.zeros(n, np.uint64)
        term[: n - k] = h[k:]
        term[left <= k] = 0
        acc = acc * np.uint64(0x2545F4914F6CDD1D) + term
    keep = (left >= width) | (np.arange(n) == np.repeat(first[:-1], count))
    return mix(acc)[keep], np.repeat(np.arange(len(offs) - 1), count)[keep]


def spec(df: DataFrame) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """part int, block int, counts binary (int64) to each block's sum: three rounds of at most 256 arrays a group (16 million tasks)."""
    import pandas as pd

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(frame["counts"].iloc[0]) // 8, np.int64)
        for x in frame["counts"]:
            out += np.frombuffer(x, np.int64)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "block": frame["block"].iloc[:1], "counts": [out.tobytes()]})

    for _ in range(3):
        parts = parts.withColumn("part", F.shiftright("part", 8)).groupBy("part", "block").applyInPandas(add, "part int, block int, counts binary")
    return {r["block"]: np.frombuffer(r["counts"], np.int64) for r in parts.select("block", "counts").collect()}


# ---- connected components -------------------------------------------------------------------------------------------


#: Edges of forests that one task joins at once (16 bytes each); more are joined in rounds.
AT_ONCE = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges a, b of each batch, or of all batches, to the edges (member, least member) of their own components."""
    if whole:
        every = list(batches)
        batches = pa.Table.from_batches(every).combine_chunks().to_batches() if every else []
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(a):
            continue
        ids, flat_ids = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = flat_ids[: len(a)], flat_ids[len(a) :]
        root = np.arange(len(ids))
        while True:
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
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]])], names=["a", "b"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of all edges, and the least of its component."""
    for batch in _forest(batches, True):
        node, root = (batch.column(k).to_numpy() for k in (0, 1))
        roots = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], names=["node", "component"])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, component (its least member) for the nodes of edges a, b (longs): a durable table.

    Each batch first shrinks its edges to a forest. If AT_ONCE edges are left at most, one task joins them; else rounds of hooking every node onto the least label of its neighbours and of jumping over parents.
    All steps are partially aggregated sums of minima and equi joins, so a hub costs no more than its edges. Rounds are logarithmic in a component's width.
    Edges with a null end are dropped, self edges do nothing, repeated edges count once; no edges give no rows.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    forest = durable(clean.mapInArrow(_forest, "a long, b long"), name)  # b < a
    if forest.count() <= AT_ONCE:
        out = durable(forest.coalesce(1).mapInArrow(_labels, "node long, component long"), name)
        release(forest)
        return out
    cur = durable(forest.distinct(), name)
    release(forest)
    sig = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    was = sig(cur)
    while was[0]:
        # every node's least neighbour (itself included), then edges rewritten to hang on it: large star, small star
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().where("b < a")
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, cur = cur, durable(small, name)
        now = sig(cur)
        release(old)
        if now == was:
            break
        was = now
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = durable(cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), name)
    release(cur)
    return out
