"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, column, durable, flat, free, mix, prefix_hash, range_hash, release, same_bytes, slices, trimmed
from textloom.llm.suffixes import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated, and of the anchors that bring equal strings together.
LENGTH, ANCHOR = 100, 32
#: Bytes of text handled at once (a longer text in overlapping pieces), and of segments in one suffix array.
CHUNK, SHARD = 1 << 18, 1 << 19
#: Bytes of segments of one key; those of a key with more are parted by what stands next to their core.
HOT = 1 << 20
#: An anchor with more than one in so many segments of every SAMPLE-th document, and LEAST of them, is common: its segments are dealt by their contents, so that no task gets them all. At most SHARE anchors are.
SAMPLE, SHARE, LEAST = 16, 2000, 64
#: Low bits of an anchor's key that hold its place.
PLACE = np.uint64((1 << 20) - 1)


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each w neighbours."""
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def segments(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, text, begin, size, and place of the anchor in it, of the segments of texts of at most 2**20 bytes: runs of LENGTH-byte strings whose anchor, the leftmost of their ANCHOR-byte substrings of least hash, is the same one.

    Equal strings have equal anchors at the same place in them wherever they are, so strings of different anchors need no comparison.
    """
    n, w = len(raw), LENGTH - ANCHOR + 1
    if n < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    pre, i = prefix_hash(raw), np.arange(n - ANCHOR + 1)
    each = range_hash(pre, i, i + ANCHOR)
    low = _slide((each & ~PLACE) | i.astype(np.uint64), w, np.minimum)
    count = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    of = np.repeat(np.arange(len(offs) - 1), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[:-1], count)
    low = low[at]
    head = np.flatnonzero(_first_of(low, of)) if len(of) else np.zeros(0, np.int64)
    last = np.r_[head[1:], len(of)] - 1 if len(of) else head
    place = (low[head] & PLACE).astype(np.int64)
    return each[place], of[head], at[head], at[last] + LENGTH - at[head], place - at[head]


#: Odd factors and masks of the 8-byte pieces of a segment.
_LANES = mix(np.arange(1, 49, dtype=np.uint64)).reshape(2, 24)


def contents(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of all bytes of raw[begin:+size], of at most 192 bytes: sums over 8-byte pieces, each mixed by a function of its own place."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    a = b = size.astype(np.uint64)
    live = np.arange(len(begin))
    for k in range(0, int(size.max(initial=0)), 8):
        if k + 8 > LENGTH:
            live = live[size[live] > k]
        left = np.minimum(size[live] - k, 8).astype(np.uint64) * np.uint64(8)
        x = eight[begin[live] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left))
        x, y = mix(x ^ _LANES[0, k // 8]), mix((x + _LANES[1, k // 8]) * np.uint64(0x9FB21C651E98DF25))
        if len(live) == len(begin):
            a, b = a + x, b + y
        else:
            a[live] += x
            b[live] += y
    return mix(a), mix(b)


def _equal_groups(raw: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each segment the index of the first one, by document and start, of the same bytes; key: equal for equal segments. Bytes are compared."""
    lead = np.arange(len(key))
    o = np.argsort(key, kind="stable")
    head = _first_of(key[o])
    group = np.cumsum(head) - 1
    many = np.bincount(group)[group] > 1
    if many.any():
        o, group = o[many], group[many]
        x = np.lexsort((start[o], doc[o], group))
        o, group = o[x], group[x]
        first = o[np.flatnonzero(_first_of(group))][np.cumsum(_first_of(group)) - 1]
        same = size[o] == size[first]
        same[same] = same_bytes(raw, begin[o[same]], raw, begin[first[same]], size[o[same]])
        lead[o[same]] = first[same]
    return lead


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True at the first row of each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals of each document as one."""
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    if not len(doc):
        return doc, start, end
    change = _first_of(doc)
    group = np.cumsum(change) - 1
    base = group * (np.int64(1) << 40)
    reach = np.maximum.accumulate(end + base)
    head = change.copy()
    head[1:] |= (start + base)[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return doc[at], start[at], np.maximum.reduceat(end, at)


#: what: for a segment its size, from bit 10 the place of its core, and COMMON where the anchor is; for covered bytes minus their number.
COMMON = 1 << 20
_ROWS = "mh long, a long, b long, doc long, start int, what int"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    made = [pa.array(x.astype(np.int32) if f.endswith(" int") else x) if isinstance(x, np.ndarray) else x for f, x in zip(schema.split(", "), columns, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=[f.split(" ")[0] for f in schema.split(", ")])


def _covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    d, s, e = merge(doc, start, end)
    none = np.zeros(len(d), np.int64)
    return _batch(_ROWS, d * np.int64(0x9E3779B1) + s, none, none, d, s, s - e)


def _windows(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first byte and offsets of ranges of at most CHUNK bytes of whole texts; a longer text in pieces that overlap by LENGTH - 1, so that each string is in one piece."""
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, side="right")) - 1)
        if offs[to] - offs[at] <= CHUNK + LENGTH - 1:
            yield at, int(offs[at]), offs[at : to + 1] - offs[at]
        else:
            for k in range(int(offs[at]), int(offs[to]) - LENGTH + 1, CHUNK):
                yield at, k, np.array([0, min(CHUNK + LENGTH - 1, int(offs[to]) - k)])
        at = to


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = flat(column(batch, "text"))
        for _, byte, own in _windows(raw, offs):
            mh, n = np.unique(segments(raw[byte : byte + own[-1]], own)[0], return_counts=True)
            yield _batch("mh long, n long", mh.view(np.int64), n.astype(np.int64))


def common_anchors(src: DataFrame) -> np.ndarray:
    """Anchors of so many segments that these should not meet in one task, sorted; only where rows go depends on them."""
    counts = durable(src.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInArrow(lambda it: trimmed(_anchors(it)), "mh long, n long").groupBy("mh").agg(F.sum("n").alias("n")).where(F.col("n") > 1), "anchors")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    found = counts.where(F.col("n") > max(LEAST, total / SHARE)).select("mh").collect()
    release(counts)
    return np.sort(np.array([r["mh"] for r in found], np.int64))


def _cut(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments; of equal ones in a batch the first only, the others at once as covered."""
    for batch in batches:
        raw, offs = flat(column(batch, "text"))
        ids = column(batch, "doc").to_numpy()
        parts = []
        for row, byte, own in _windows(raw, offs):
            mh, of, begin, size, core = segments(raw[byte : byte + own[-1]], own)
            a, b = contents(raw, begin + byte, size)
            parts.append((mh, a, b, of + row, begin + byte, size, core))
        if not parts:
            continue
        mh, a, b, of, begin, size, core = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc, start = ids[of], begin - offs[of]
        lead = _equal_groups(raw, mh ^ mix(a), doc, start, begin, size)
        f = np.flatnonzero(lead == np.arange(len(lead)))
        f = f[np.argsort(mh[f])]
        key = mh[f].view(np.int64)
        mark = np.isin(key, common) * COMMON
        yield _batch(_ROWS, key, a[f].view(np.int64), b[f].view(np.int64), doc[f], start[f], size[f] | (core[f] << 10) | mark)
        again = (doc != doc[lead]) | (start != start[lead])
        yield _covered(doc[again], start[again], (start + size)[again])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content and place: all but the first of equal segments as covered, firsts whose anchor has other contents too, or is common, as segments; the rest are done. State between batches is two rows."""
    held = None  # the first segment of the current anchor while it has no company
    prev = None  # the current content's anchor, hashes, document, start
    for batch in batches:
        what = column(batch, "what").to_numpy()
        if (what < 0).any():
            yield batch.filter(pa.array(what < 0))
        mh, a, b, doc, start, what = (column(batch, k).to_numpy()[what >= 0] for k in ("mh", "a", "b", "doc", "start", "what"))
        if not len(mh):
            continue
        first = _first_of(mh, a, b)
        if prev is not None and prev[:3] == (mh[0], a[0], b[0]):
            first[0] = False
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        known = np.maximum(lead, 0)
        ld, ls = np.where(lead >= 0, doc[known], prev[3] if prev else 0), np.where(lead >= 0, start[known], prev[4] if prev else 0)
        again = ~first & ((doc != ld) | (start != ls))
        if again.any():
            yield _covered(doc[again], start[again].astype(np.int64), start[again].astype(np.int64) + (what[again] & 1023))
        f = np.flatnonzero(first)
        if len(f):
            m = mh[f]
            new = _first_of(m)
            if prev is not None and prev[0] == m[0]:
                new[0] = False
            out = f[~new | np.r_[~new[1:], False] | (what[f] >= COMMON)]
            if not new[0] and held is not None:
                yield _batch(_ROWS, *(np.array([v]) for v in held))
            held = tuple(x[f[-1]] for x in (mh, a, b, doc, start, what)) if new[-1] and what[f[-1]] < COMMON else None
            if len(out):
                yield _batch(_ROWS, *(x[out] for x in (mh, a, b, doc, start, what)))
        prev = (mh[-1], a[-1], b[-1], ld[-1] if not first[-1] else doc[-1], ls[-1] if not first[-1] else start[-1])


#: Segments with their bytes: the key, the place and length of what all strings of the key have in common.
_SEGS = "mh long, doc long, start int, core int, held int, seg binary"


def _lists(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary values raw[begin:end]."""
    size = end - begin
    offs = np.r_[0, np.cumsum(size)]
    data = raw[np.arange(offs[-1]) + np.repeat(begin - offs[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their wanted segments to the segments' bytes."""
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            raw, offs = flat(column(part, "text"))
            wants = column(part, "wants")
            of = np.repeat(np.arange(len(part)), np.diff(wants.offsets.to_numpy()))
            flat_wants = wants.flatten()
            mh, start, what = (flat_wants.field(k).to_numpy(zero_copy_only=False) for k in ("mh", "start", "what"))
            doc, begin, size = column(part, "doc").to_numpy()[of], offs[of] + start, what & 1023
            for j in range(0, len(mh), 8192):
                x = slice(j, j + 8192)
                yield _batch(_SEGS, mh[x], doc[x], start[x], (what[x] >> 10) & 1023, np.full(len(mh[x]), ANCHOR), _lists(raw, begin[x], begin[x] + size[x]))


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of crowded keys in two: the strings that hold half of what they miss to LENGTH bytes to the left of the core, and those that hold as much to its right. The longer core is the key. Equal ones of a batch as in _cut; covered bytes have no segment."""
    for batch in batches:
        if not len(batch):
            continue
        doc, start, core, held = (column(batch, k).to_numpy().astype(np.int64) for k in ("doc", "start", "core", "held"))
        raw, offs = flat(column(batch, "seg"))
        last = np.diff(offs) - LENGTH  # last start of a string
        more = (LENGTH - held + 1) // 2
        left, right = np.flatnonzero(core >= more), np.flatnonzero(core - more < last)
        row = np.concatenate([left, right])
        skip = np.concatenate([np.zeros(len(left), np.int64), np.maximum(core - more + 1, 0)[right]])
        size = np.concatenate([np.minimum(core - more, last)[left] + LENGTH, (last + LENGTH)[right] - skip[len(left) :]])
        place = np.concatenate([(core - more)[left], core[right]]) - skip
        begin, long = offs[row] + skip, (held + more)[row]
        pre = [prefix_hash(raw)] if len(raw) < (1 << 20) else None
        key = range_hash(pre[0], begin + place, begin + place + long) if pre else np.concatenate([range_hash(prefix_hash(raw[b + p : b + p + z]), np.array([0]), np.array([z])) for b, p, z in zip(begin, place, long, strict=True)])
        d, s = doc[row], start[row] + skip
        a, _ = contents(raw, begin, size)
        lead = _equal_groups(raw, key ^ mix(a), d, s, begin, size)
        f = np.flatnonzero(lead == np.arange(len(lead)))
        for j in range(0, len(f), 8192):
            x = f[j : j + 8192]
            yield _batch(_SEGS, key[x].view(np.int64), d[x], s[x], place[x], long[x], _lists(raw, begin[x], begin[x] + size[x]))
        again = (d != d[lead]) | (s != s[lead])
        yield _done(d[again], s[again], (s + size)[again])


def _done(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    d, s, e = merge(doc, start, end)
    return _batch(_SEGS, d * np.int64(0x9E3779B1) + s, d, s, s - e, np.zeros(len(d), np.int64), pa.nulls(len(d), pa.binary()))


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, content and place: the first of equal segments, the others as covered. State between batches is one row."""
    prev = None
    for batch in batches:
        bare = column(batch, "seg").is_null()
        yield batch.filter(bare)
        rows = batch.filter(pa.compute.invert(bare))
        if not len(rows):
            continue
        if prev is not None:
            rows = pa.Table.from_batches([prev, rows]).combine_chunks().to_batches()[0]
        mh, doc, start = (column(rows, k).to_numpy().astype(np.int64) for k in ("mh", "doc", "start"))
        raw, offs = flat(column(rows, "seg"))
        size = np.diff(offs)
        equal = np.zeros(len(rows), bool)
        near = np.flatnonzero((mh[1:] == mh[:-1]) & (size[1:] == size[:-1]))
        equal[near + 1] = same_bytes(raw, offs[near + 1], raw, offs[near], size[near])
        lead = np.maximum.accumulate(np.where(equal, 0, np.arange(len(rows))))
        again = equal & ((doc != doc[lead]) | (start != start[lead]))
        yield _done(doc[again], start[again], (start + size)[again])
        keep = np.flatnonzero(~equal)
        yield rows.take(pa.array(keep[1:] if prev is not None else keep))
        prev = rows.slice(int(lead[-1]), 1)


def shard_repeats(raw: np.ndarray, offs: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of what the strings of segments cover that also start earlier, from one suffix array of all segments."""
    size = np.diff(offs)
    n = len(raw) + len(size)
    t = np.ones(n + 1, np.uint8)  # 1 ends a segment, 0 the array; UTF-8 has no byte above 244
    t[-1] = 0
    seg = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) + seg
    t[place] = raw + np.uint8(2)
    sa = suffix_array(t)
    same = permuted_prefixes(t, sa, 1)
    left = np.zeros(n + 1, np.int64)  # bytes to the segment's end
    left[place] = np.repeat(offs[1:], size) - np.arange(len(raw))
    of = np.zeros(n + 1, np.int64)
    of[place] = seg
    sa_ok = sa[left[sa] >= LENGTH]
    if not len(sa_ok):
        return (np.zeros(0, np.int64),) * 3
    head = same[sa_ok] < LENGTH
    head[0] = True
    group = np.cumsum(head) - 1
    d = doc[of[sa_ok]]
    p = start[of[sa_ok]] + (size[of[sa_ok]] - left[sa_ok])
    o = np.lexsort((p, d, group))
    least = o[np.flatnonzero(_first_of(group[o]))]
    cover = (d != d[least][group]) | (p != p[least][group])
    return merge(d[cover], p[cover], p[cover] + LENGTH)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole keys are gathered up to SHARD bytes and sorted together; the covered intervals come out."""
    kept: list[pa.RecordBatch] = []
    size = 0

    def run(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        if len(table):
            raw, offs = flat(table["seg"].chunk(0))
            d, s, e = shard_repeats(raw, offs, table["doc"].to_numpy(), table["start"].to_numpy().astype(np.int64))
            yield _batch("doc long, start int, size int", d, s, e - s)

    for batch in batches:
        if not len(batch):
            continue
        mh = column(batch, "mh").to_numpy()
        edge = np.flatnonzero(_first_of(mh))  # where another key begins; the first may go on with the key before
        if kept and column(kept[-1], "mh")[-1].as_py() == mh[0]:
            edge = edge[1:]
        _, offs = flat(column(batch, "seg"))
        at = 0
        for k in edge.tolist():
            if size + offs[k] - offs[at] >= SHARD:
                yield from run([*kept, batch.slice(at, k - at)])
                kept, size, at = [], 0, k
        kept.append(batch.slice(at))
        size += int(offs[-1] - offs[at])
    if kept:
        yield from run(kept)


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start, size of byte intervals (may overlap) that together are all bytes covered by a LENGTH-byte string which also starts earlier.

    1. Texts are cut into segments of strings with a common anchor; of equal segments in a batch one goes on (bytes are compared). 2. Shuffled by anchor (those of a common anchor by their contents, as they surely have company), all but the first of equal segments (128 bits of two hashes of all bytes) are covered at once,
    and firsts that are alone with their anchor are done. 3. The other firsts are fetched from their texts. Segments of a key with more than HOT bytes are parted in two by what stands next to their common core, again and again, until their keys are small:
    the core grows to LENGTH bytes in seven steps at most, where all strings of a key are equal. 4. Each shard of whole keys is sorted into a suffix array, where strings with a common prefix of LENGTH meet.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(f"doc is not null and octet_length(text) >= {LENGTH}")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    common = common_anchors(src)
    goal = F.when(F.col("what").bitwiseAND(COMMON) == 0, F.col("mh")).otherwise(F.xxhash64("mh", "a"))
    met = src.mapInArrow(lambda it: trimmed(_cut(it, common)), _ROWS).repartition(n, goal).sortWithinPartitions("mh", "a", "b", "doc", "start").mapInArrow(lambda it: trimmed(_meet(it)), _ROWS)
    met = durable(met.select(F.when(F.col("what") > 0, F.col("mh")).alias("mh"), "doc", "start", "what"), "met")
    out = met.where("what < 0").select("doc", "start", (-F.col("what")).alias("size"))
    want = met.where("what > 0")
    crowded = durable(want.groupBy("mh").agg(F.sum(F.col("what").bitwiseAND(1023)).alias("size")).where(F.col("size") > HOT).select("mh"), "crowded")

    def fetched(some: DataFrame) -> DataFrame:
        lists = some.groupBy("doc").agg(F.collect_list(F.struct("mh", "start", "what")).alias("wants"))
        return src.join(lists, "doc").select("doc", "text", "wants").mapInArrow(lambda it: trimmed(_fetch(it)), _SEGS)

    def sort(segs: DataFrame) -> DataFrame:
        return segs.select("mh", "doc", "start", "seg").repartition(n, "mh").sortWithinPartitions("mh").mapInArrow(lambda it: trimmed(_sort(it)), "doc long, start int, size int")

    if crowded.isEmpty():
        return out.union(sort(fetched(want)))
    out = out.union(sort(fetched(want.join(crowded, "mh", "left_anti"))))
    hot = fetched(want.join(crowded, "mh", "left_semi"))
    for _ in range(7):  # what is missing to LENGTH is halved each time
        halves = hot.mapInArrow(lambda it: trimmed(_part(it)), _SEGS).withColumn("h", F.xxhash64("seg"))
        step = durable(halves.repartition(n, "mh", "h").sortWithinPartitions("mh", "h", "seg", "doc", "start").drop("h").mapInArrow(lambda it: trimmed(_same(it)), _SEGS), "parted")
        out = out.union(step.where("seg is null").select("doc", "start", (-F.col("core")).alias("size")))
        segs = step.where("seg is not null")
        crowded = durable(segs.groupBy("mh").agg(F.sum(F.octet_length("seg")).alias("size")).where(F.col("size") > HOT).select("mh"), "crowded")
        out = out.union(sort(segs.join(crowded, "mh", "left_anti")))
        if crowded.isEmpty():
            break
        hot = segs.join(crowded, "mh", "left_semi").select(segs.columns)
    return out


NEW = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, -2, CHUNK, 512):
            raw, offs = flat(column(part, -2))
            spans = column(part, -1)
            if spans.null_count:
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy())].astype(np.int32)), spans.flatten())
            row = np.repeat(np.arange(len(part)), np.diff(spans.offsets.to_numpy()))
            values = spans.flatten()
            s, z = (values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "size"))
            row, s, e = merge(row, s, s + z)
            room = np.diff(offs)
            s, e = np.minimum(s, room[row]), np.minimum(e, room[row])
            n, removed = np.bincount(row[e > s], minlength=len(part)), np.bincount(row, weights=e - s, minlength=len(part)).astype(np.int64)
            drop = np.zeros(len(raw) + 1, np.int32)
            np.add.at(drop, offs[row] + s, 1)
            np.add.at(drop, offs[row] + e, -1)
            keep = np.cumsum(drop)[:-1] == 0
            left = raw[keep].tobytes()
            ends = np.r_[0, np.cumsum(keep)][offs].tolist()
            pieces = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sha = [hashlib.sha256(x).hexdigest() for x in pieces]
            fields = [f"c{k}" for k in range(part.num_columns - 2)]
            text = [x.decode("utf-8", "ignore") for x in pieces]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(room), pa.array(removed), pa.array(n.astype(np.int64)), pa.array(sha), pa.array(text, pa.string())], names=[*fields, *NEW])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text (each after the prefix) of each text without the bytes that a LENGTH-byte string covers which also starts earlier (smaller key, or same document and earlier start).

    Strings never cross documents and are judged on the input. A null text counts as empty, one shorter than LENGTH loses nothing; a row with a null key is not compared and loses nothing. Long texts are handled whole, in overlapping pieces; an empty table gives no rows.
    Rows that repeat a key count as one document: equal rows don't remove each other. Columns of docs stay, but those with one of the new names are replaced. kept_sha256 is of the remaining bytes; kept_text drops what is left of a cut character.
    """
    new = [prefix + c for c in NEW]
    base = docs.drop(*new)
    own, hidden = free("__doc", *base.columns), [free("__text", *base.columns), free("__spans", *base.columns)]
    spans = covered(docs, key, text).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias(hidden[1])).withColumnRenamed("doc", own)
    base = base.withColumn(hidden[0], docs[text])
    joined = base.join(spans, base[key].cast("long") == F.col(own), "left").drop(own)
    kinds = [f.dataType.simpleString() for f in base.schema.fields[:-1]]
    names = [*base.columns[:-1], *new]
    # names of the caller's columns may be anything, so columns go by place
    plain = joined.mapInArrow(lambda it: trimmed(_finish(it)), ", ".join([*(f"c{k} {t}" for k, t in enumerate(kinds)), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"]))
    return plain.toDF(*names)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("text", "kept_text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its repeated bytes cut out; the rest of a cut character goes too. n_chars follows the text; a text that loses nothing, and every other column, stays as it is."""
    prefix = "cut_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    lost, kept = F.col(f"{prefix}n_removed") > 0, F.col(f"{prefix}kept_text")
    own = {"text": F.when(lost, kept).otherwise(F.col("text")), "n_chars": F.when(lost, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return remove_repeats(docs, prefix=prefix).select(*(own.get(c, F.col(c)).alias(c) for c in docs.columns))
