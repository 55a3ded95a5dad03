"""Benchmark decontamination: latent semantic search of TF-IDF passages, then longest common subsequences and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, column, flat, run_hashes, slices, summed, trimmed, words

#: Words of a block; a passage is two neighbouring blocks.
BLOCK = 32
#: A word in more than this share of all blocks outside windows that hold much of its item is common; an item with fewer than FEW rarer words is compared by all its words.
COMMON, FEW = 0.01, 4
#: Latent dimensions, extra random ones, and words of which the sums of a fit travel together.
RANK, EXTRA, TOGETHER = 192, 16, 512
#: Shares of an item's words in common order that decide: with the answer, and without.
WITH_ANSWER, ALONE = 0.5, 0.75
#: An item's answer: so many of its last compared words, of which half must occur.
ANSWER = 5
#: Items and bytes of items searched at once: at most 175,000 words of three bytes, so a broadcast of at most 150 MB; a larger benchmark is searched in blocks.
ITEMS, ITEM_BYTES = 20_000, 1 << 19
CHUNK = 1 << 18
#: An item of fewer words than SHORT is looked for in so many words a word of it: a few words come in order by chance in a whole window.
SHORT, STRETCH = 16, 2
#: Rows of a run that are added up one after another.
PIECE = 32
#: Counts of a word in a window from here on are taken for any number.
MANY = 255
#: Counts of windows by items that are held at once.
CELLS = 1 << 22


def _hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the index of each text's first."""
    starts, ends, first = words(raw, offs)
    return run_hashes(raw, starts, ends), first


@dataclass
class Index:
    vocab: np.ndarray  # sorted hashes of the words compared
    idf: np.ndarray
    items: list  # (item id, places in vocab of its compared words in order)
    basis: np.ndarray | None = None  # words x dimensions
    parts: np.ndarray | None = None  # unit latent vectors of the items' passages
    part_of: np.ndarray | None = None  # their items
    strides: list | None = None  # of each window stride: blocks, and _postings


class Lookup:
    """Places of hashes in a sorted array of them: buckets by their highest bits, a few probes each."""

    def __init__(self, vocab: np.ndarray) -> None:
        self.vocab, self.shift = vocab, np.uint64(64 - max(len(vocab).bit_length() + 2, 8))
        self.start = np.searchsorted(vocab >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))
        self.probes = int(np.diff(self.start).max(initial=0))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and where."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        ok, where = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        for k in range(self.probes):
            here = at + k
            hit = np.flatnonzero(here < end)
            hit = hit[self.vocab[here[hit]] == h[hit]]
            ok[hit], where[hit] = True, here[hit]
        return ok, where


def _tokens(raw: np.ndarray, offs: np.ndarray, vocab: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary words in order: their place in the vocabulary, block and word number; and the document of every block."""
    h, first = _hashes(raw, offs)
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    head = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(offs) - 1), count)
    word = np.arange(len(h)) - first[doc]
    ok, at = vocab(h)
    return at[ok], (head[doc] + word // BLOCK)[ok], word[ok], np.repeat(np.arange(len(offs) - 1), blocks)


def _frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Blocks that hold each word, all blocks, and documents with words: over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, find = np.zeros(len(vocab) + 2, np.int64), Lookup(shared.value)
        for batch in batches:
            for part in slices(batch, "t", CHUNK):
                term, block, _, doc = _tokens(*flat(column(part, "t")), find)
                both = np.unique(block * len(vocab) + term) if len(term) else term
                total[:-2] += np.bincount(both % max(len(vocab), 1), minlength=len(vocab))
                total[-2:] += (len(doc), len(np.unique(doc)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "block", "counts"])

    got = summed(docs.select("t").mapInArrow(lambda it: trimmed(count(it)), "part int, block int, counts binary")).get(0, np.zeros(len(vocab) + 2, np.int64))
    return got[:-2], int(got[-2]), int(got[-1])


def _passages(block: np.ndarray, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of value (a row for each block) over each block and the next one of its document."""
    out = value.copy()
    if len(doc) > 1:
        out[:-1] += value[1:]
        last = np.flatnonzero(doc[1:] != doc[:-1])
        out[last] = value[last]
    return out


def _block_sums(n: int, block: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((n, *rows.shape[1:]), rows.dtype)
    if len(block):
        head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        out[block[head]] = np.add.reduceat(rows, head, axis=0)
    return out


def _sums(rows: np.ndarray, at: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sum of rows[at[i]] over each run of places i that begins at a head: the first rows of all runs, then the second ones, and so on; runs of over PIECE are summed in pieces."""
    n = np.diff(head, append=len(at))
    if n.max(initial=0) > PIECE:
        pieces = -(-n // PIECE)
        first = np.cumsum(pieces) - pieces
        begins = np.repeat(head - first * PIECE, pieces) + np.arange(pieces.sum()) * PIECE
        return _sums(_sums(rows, at, begins), np.arange(len(begins)), first)
    o = np.argsort(-n, kind="stable")
    begins, longer = head[o], len(n) - np.cumsum(np.bincount(n, minlength=1))
    total = rows.take(at[begins], axis=0)
    for k in range(1, int(n.max(initial=0))):
        total[: longer[k]] += rows.take(at[begins[: longer[k]] + k], axis=0)
    out = np.empty_like(total)
    out[o] = total
    return out


def _add_times(raw: np.ndarray, offs: np.ndarray, index: Index, find: Lookup, scaled: np.ndarray, z: np.ndarray) -> float:
    """Add C' C scaled to z, for the counts C of words in the passages of the texts; the squared norm of the passages A, which are C times the words' weights."""
    term, block, _, doc = _tokens(raw, offs, find)
    if not len(term):
        return 0.0
    value = np.zeros((len(doc), scaled.shape[1]), scaled.dtype)
    head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    value[block[head]] = _sums(scaled, term, head)
    y = _passages(block, doc, value)
    back = np.ascontiguousarray(_passages(block, doc[::-1], y[::-1])[::-1])  # each block and the one before it
    o = np.argsort(term, kind="stable")
    head = np.flatnonzero(np.diff(term[o], prepend=-1))
    z[term[o[head]]] += _sums(back, block[o], head)
    return float((index.idf[term].astype(np.float32).astype(float) ** 2).sum() * 2)


def _product(docs: DataFrame, index: Index, omega: np.ndarray) -> tuple[np.ndarray, float]:
    """A' A omega for the passages A of all documents, and A's squared norm."""
    shared = docs.sparkSession.sparkContext.broadcast((index, omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idx, om = shared.value
        z, energy, find, weight = np.zeros(om.shape), 0.0, Lookup(idx.vocab), idx.idf.astype(np.float32)[:, None]
        scaled = weight * om
        for batch in batches:
            for part in slices(batch, "t", CHUNK):
                energy += _add_times(*flat(column(part, "t")), idx, find, scaled, z)
        z *= weight
        # sums travel as integers: two to the 20th parts
        for k, x in enumerate([np.array([energy]), *(z[j : j + TOGETHER] for j in range(0, len(z), TOGETHER))]):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([np.round(x * (1 << 20)).astype(np.int64).tobytes()], pa.binary())], names=["part", "block", "counts"])

    got = summed(docs.select("t").mapInArrow(lambda it: trimmed(run(it)), "part int, block int, counts binary"))
    if not got:
        return np.zeros(omega.shape), 0.0
    return np.concatenate([got[k] for k in range(1, len(got))]).reshape(omega.shape) / (1 << 20), float(got[0][0]) / (1 << 20)


def _fit(docs: DataFrame, index: Index, texts: list[str]) -> None:
    """Randomised SVD of items and the passages of all documents: a random test matrix, two products with A'A, and the eigenvectors of the small projection. Items weigh as much as all passages together."""
    raw, offs = flat(pa.array(texts, pa.string()))
    weight = index.idf.astype(np.float32)[:, None]
    size, find = min(RANK + EXTRA, len(index.vocab)), Lookup(index.vocab)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(index.vocab), size)))[0].astype(np.float32)
    for step in range(2):
        a, ea = _product(docs, index, q)
        b = np.zeros(q.shape)
        eb = _add_times(raw, offs, index, find, weight * q, b)
        b *= weight
        z = a + b * (ea / eb if ea > 0 and eb > 0 else 1.0)
        if step == 0:
            q = np.linalg.qr(z)[0].astype(np.float32)
    value, vector = np.linalg.eigh(q.T.astype(float) @ z)
    index.basis = np.ascontiguousarray((q @ vector[:, np.argsort(-value)[:RANK]]).astype(np.float32))
    term, block, _, doc = _tokens(raw, offs, find)
    w = index.idf[term]
    latent = _passages(block, doc, _block_sums(len(doc), block, w[:, None].astype(np.float32) * index.basis[term]))
    norm = np.linalg.norm(latent, axis=1)
    ok = norm > 0
    index.parts, index.part_of = (latent / np.maximum(norm, 1e-12)[:, None])[ok], doc[ok]


def masks(words: list) -> dict:
    """For each word a number with a bit for each of its places."""
    out: dict = {}
    for k, x in enumerate(words):
        out[x] = out.get(x, 0) | (1 << k)
    return out


def common_subsequence(a: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of n words, given by masks(), and others: a row of the table is an integer of a bit for each of the n, set where it does not grow."""
    full = row = (1 << n) - 1
    for m in filter(None, map(a.get, b)):
        both = row & m
        row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def _order(item: tuple[dict, int], there: list, word: list) -> tuple[int, int, int]:
    """Most of an item's words that a window has in common order, and the first and last (exclusive) place looked at: the whole window, but of a short item its best stretch. there, word: the window's words and their numbers in the text.

    Of stretches with equally many, the one with more of the item's last words counts.
    """
    places, n = item
    if n >= SHORT:
        return common_subsequence(places, n, there), 0, len(there)
    hits = [k for k, x in enumerate(there) if x in places]
    best, chosen = (0, 0), (0, 0)
    for i, lo in enumerate(hits):
        hi, seen = i, 0
        while hi < len(hits) and word[hits[hi]] < word[lo] + STRETCH * n:
            seen |= places[there[hits[hi]]]
            hi += 1
        if seen.bit_count() >= WITH_ANSWER * n:
            end = hits[hi - 1] + 1
            found = common_subsequence(places, n, there[lo:end]), (seen >> max(n - ANSWER, 0)).bit_count()
            if found > best:
                best, chosen = found, (lo, end)
    return best[0], *chosen


def _answer(item: tuple[dict, int], there: list) -> float:
    """Share of an item's last words that are there."""
    places, n = item
    seen = 0
    for x in there:
        seen |= places.get(x, 0)
    return (seen >> max(n - ANSWER, 0)).bit_count() / min(n, ANSWER)


def _postings(index: Index, chosen: np.ndarray, common: np.ndarray) -> tuple:
    """Of the chosen items: where each word's postings begin, their items and how often each holds the word, and how many of these words a window must have at least.

    A window with a share of WITH_ANSWER of an item's words has so many of them even if it has every word left out here, so no item is lost: common words are left out, the most common first, while some are needed of the rest.
    """
    words_of, item, times, need = [], [], [], np.zeros(len(chosen), np.int64)
    for k, j in enumerate(chosen.tolist()):
        word, count = np.unique(index.items[j][1], return_counts=True)
        least = int(np.ceil(WITH_ANSWER * len(index.items[j][1])))
        order = np.argsort(index.idf[word], kind="stable")
        out = np.cumsum(count[order])
        left = order[~(common[word[order]] & (out <= least - min(3, least)))]
        words_of.append(word[left])
        item.append(np.full(len(left), k))
        times.append(count[left])
        need[k] = least - (count.sum() - count[left].sum())
    w, item, times = np.concatenate(words_of), np.concatenate(item), np.concatenate(times)
    o = np.argsort(w, kind="stable")
    every = [np.unique(index.items[j][1], return_counts=True) for j in chosen.tolist()]
    sizes = np.array([len(x) for x, _ in every])
    whole = np.r_[0, np.cumsum(sizes)], np.concatenate([x for x, _ in every]), np.concatenate([c for _, c in every]), np.array([np.ceil(WITH_ANSWER * c.sum()) for _, c in every])
    return chosen, np.searchsorted(w[o], np.arange(len(index.vocab) + 1)), item[o], times[o], need, whole


def _strides(index: Index, size: np.ndarray, common: np.ndarray) -> list:
    """Items by the stride of their windows in blocks. Windows are two strides long, so that text of an item's whole length and a quarter more is in one window; long strides are rounded up to a sixteenth."""
    stride = 1 - (-(size + size // 4) // BLOCK)
    step = 1 << np.maximum(np.floor(np.log2(stride)).astype(np.int64) - 4, 0)
    stride = -(-stride // step) * step
    return [(int(s), _postings(index, np.flatnonzero(stride == s), common)) for s in np.unique(stride)]


def _candidates(term: np.ndarray, block: np.ndarray, doc: np.ndarray, stride: int, postings: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First and last block (exclusive) and item of all windows that have a share of WITH_ANSWER of the item's words, each as often as the item at most: no common order can be longer."""
    chosen, head, item, times, need, (edges, words_of, counts, least) = postings
    start = np.searchsorted(doc, doc)  # the first block of each block's document
    stop = np.searchsorted(doc, doc, side="right")
    place = np.arange(len(doc)) - start
    unit = np.cumsum(place % stride == 0) - 1  # runs of stride blocks within documents
    lead = np.flatnonzero(place % stride == 0)
    follows = np.r_[place[lead][1:] > 0, False]  # the next run is of the same document: a window holds both
    size = len(head) - 1
    n = head[1:] - head[:-1]
    u = unit[block]
    edge = np.searchsorted(u, np.arange(len(lead) + 1))
    step = max(1, min(CELLS // len(chosen), CELLS // size))
    for lo in range(0, len(lead), step):
        hi = min(lo + step, len(lead))
        own = slice(edge[lo], edge[min(hi + 1, len(lead))])
        here = u[own]
        key = ((here - lo) * size + term[own]).astype(np.int32)  # at most CELLS, or a window of one vocabulary
        key = np.sort(np.concatenate([key[here < hi], key[(here > lo) & follows[here - 1]] - np.int32(size)]))
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        often = np.diff(begins, append=len(key))
        key = key[begins].astype(np.int64)
        held = np.zeros((hi - lo) * size, np.uint8)
        held[key] = np.minimum(often, MANY)
        window = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(key, np.arange(hi - lo + 1) * size)))
        t = key - window * size
        m = n[t]
        if not m.sum():
            continue
        row = np.repeat(np.arange(len(m)), m)
        at = head[t][row] + np.arange(m.sum()) - (np.cumsum(m) - m)[row]
        count = np.bincount(window[row] * len(chosen) + item[at], weights=np.minimum(times[at], often[row]), minlength=(hi - lo) * len(chosen)).reshape(hi - lo, -1)
        x, y = np.nonzero(count >= need)
        keep = np.zeros(len(x), bool)
        for k in range(0, len(x), 1 << 15):
            w, v = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
            m = edges[v + 1] - edges[v]
            row = np.repeat(np.arange(len(v)), m)
            at = np.arange(m.sum()) - (np.cumsum(m) - m)[row] + edges[v][row]
            there = held[w[row] * size + words_of[at]]
            keep[k : k + (1 << 15)] = np.bincount(row, weights=np.where(there < MANY, np.minimum(counts[at], there), counts[at]), minlength=len(v)) >= least[v]
        x, y = x[keep], y[keep]
        first = lead[lo + x]
        yield first, np.minimum(first + 2 * stride, stop[first]), chosen[y]


def _cosine(index: Index, term: np.ndarray, block: np.ndarray, j: int) -> float:
    """Highest cosine of the passages of these words' blocks and those of an item."""
    own = index.parts[index.part_of == j]
    if not len(own) or not len(term):
        return 0.0
    at = block - block[0]
    latent = _block_sums(int(at[-1]) + 1, at, index.idf[term][:, None].astype(np.float32) * index.basis[term])
    latent = _passages(at, np.zeros(len(latent), np.int64), latent)
    return float((latent @ own.T / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]).max())


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    items_of, find = [(masks(w.tolist()), len(w)) for _, w in index.items], Lookup(index.vocab)
    for batch in batches:
        for part in slices(batch, "t", CHUNK):
            ids = column(part, "id").to_numpy()
            term, block, word, doc = _tokens(*flat(column(part, "t")), find)
            first, every = np.searchsorted(block, np.arange(len(doc) + 1)).tolist(), term.tolist()
            out = {}
            for stride, postings in index.strides if len(term) else []:
                for lows, highs, items in _candidates(term, block, doc, stride, postings):
                    for lo, hi, j in zip(lows.tolist(), highs.tolist(), items.tolist(), strict=True):
                        key = (int(doc[lo]), j)
                        if out.get(key, (0,))[0] >= 1:
                            continue
                        s = slice(first[lo], first[hi])
                        there = every[s]
                        order, begin, end = _order(items_of[j], there, word[s].tolist() if items_of[j][1] < SHORT else [])
                        lcs = order / items_of[j][1]
                        if lcs < WITH_ANSWER:
                            continue
                        answer = _answer(items_of[j], there[begin:end])
                        if (lcs >= ALONE or answer >= 0.5) and (key not in out or out[key][0] < lcs):
                            out[key] = (lcs, answer, lo, hi)
            got = sorted(out)
            out = {(d, j): (*out[d, j][:2], _cosine(index, term[(s := slice(first[out[d, j][2]], first[out[d, j][3]]))], block[s], j)) for d, j in got}
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[[d for d, _ in got]] if got else [], pa.int64()), pa.array([index.items[j][0] for _, j in got], pa.int64()), *(pa.array([out[k][f] for k in got], pa.float64()) for f in range(3))],
                names=["doc_id", "item_id", "lcs", "answer", "cosine"],
            )


def _copied(docs: DataFrame, index: Index) -> list:
    """For each item and each of its distinct words, the blocks that hold the word in windows with a share of WITH_ANSWER of the item's words in common order: over all documents."""
    of_item = [np.unique(w) for _, w in index.items]
    head = np.r_[0, np.cumsum([len(w) for w in of_item])]
    shared = docs.sparkSession.sparkContext.broadcast((index, of_item, head))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idx, own, at = shared.value
        items_of, find = [(masks(w.tolist()), len(w)) for _, w in idx.items], Lookup(idx.vocab)
        total = np.zeros(at[-1], np.int64)
        for batch in batches:
            for part in slices(batch, "t", CHUNK):
                term, block, word, doc = _tokens(*flat(column(part, "t")), find)
                first, every = np.searchsorted(block, np.arange(len(doc) + 1)).tolist(), term.tolist()
                for stride, postings in idx.strides if len(term) else []:
                    found = [np.zeros(0, np.int64)]
                    for lows, highs, items in _candidates(term, block, doc, stride, postings):
                        for lo, hi, j in zip(lows.tolist(), highs.tolist(), items.tolist(), strict=True):
                            s = slice(first[lo], first[hi])
                            if _order(items_of[j], every[s], word[s].tolist() if items_of[j][1] < SHORT else [])[0] >= WITH_ANSWER * items_of[j][1]:
                                place = np.minimum(np.searchsorted(own[j], term[s]), len(own[j]) - 1)
                                hit = own[j][place] == term[s]
                                found.append(block[s][hit] * at[-1] + at[j] + place[hit])
                    total += np.bincount(np.unique(np.concatenate(found)) % at[-1], minlength=at[-1])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "block", "counts"])

    got = summed(docs.select("t").mapInArrow(lambda it: trimmed(count(it)), "part int, block int, counts binary")).get(0, np.zeros(head[-1], np.int64))
    return [got[a:b] for a, b in zip(head[:-1], head[1:], strict=True)]


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, lcs (share of the item's compared words in common order), answer (share of its last words present), cosine: every document that holds a benchmark item, or a paraphrase in its order.

    Words are runs of letters and digits of the lower-case text. Weights come from counts over all documents. Null or empty texts, and rows with a null key, neither leak nor are leaked;
    of rows that repeat an item id the least text counts, a document's row may come more than once if its key repeats. Empty tables give no rows. Other columns are not read.
    Long texts are searched window by window, whole; of a document's windows the one with most of an item's words in order stands for the pair, of equal ones the first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.lower(F.col(text)).alias("t"))
    known = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item).cast("long").alias("i")).agg(F.min(F.lower(item_text)).alias("t"))
    size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).collect()[0]
    blocks = max(1, -(-size[0] // ITEMS), -(-size[1] // ITEM_BYTES))
    out = None
    for k in range(blocks):
        rows = sorted((r["i"], r["t"]) for r in known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect())
        found = _leaks_of(spark, src, rows)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of(spark, src: DataFrame, rows: list) -> DataFrame:
    texts = [t for _, t in rows]
    h, first = _hashes(*flat(pa.array(texts, pa.string())))
    every = np.unique(h)
    df, n_blocks, _ = _frequencies(src, every)
    _, at = Lookup(every)(h)
    # copies of a leak are no sign of a common word: their windows, by all words of the item, do not count
    texts_of = [(j, at[first[j] : first[j + 1]]) for j in range(len(rows)) if first[j + 1] > first[j]]
    whole = Index(every, np.log((n_blocks + 2) / (df + 1)), texts_of)
    times = df[at]
    if texts_of:
        whole.strides = _strides(whole, np.array([len(w) for _, w in texts_of]), df > COMMON * n_blocks)
        for (j, w), blocks in zip(texts_of, _copied(src, whole), strict=True):
            times[first[j] : first[j + 1]] -= blocks[np.searchsorted(np.unique(w), w)]
    rare = times <= max(COMMON * n_blocks, 1)
    kept = np.zeros(len(every), bool)
    seqs = []
    for j in range(len(rows)):
        own = slice(int(first[j]), int(first[j + 1]))
        w = at[own][rare[own]] if rare[own].sum() >= FEW else at[own]
        kept[w] = True
        seqs.append(w)
    place = np.cumsum(kept) - 1
    index = Index(every[kept], np.log((n_blocks + 2) / (df[kept] + 1)), [(i, place[w]) for (i, _), w in zip(rows, seqs, strict=True)])
    used = [k for k, (_, w) in enumerate(index.items) if len(w)]
    if not used:
        return spark.createDataFrame([], "doc_id long, item_id long, lcs double, answer double, cosine double")
    index.items = [index.items[k] for k in used]
    index.strides = _strides(index, np.diff(first)[used], df[kept] > COMMON * n_blocks)
    _fit(src, index, [texts[k] for k in used])
    shared = spark.sparkContext.broadcast(index)
    return src.mapInArrow(lambda it: trimmed(_search(it, shared)), "doc_id long, item_id long, lcs double, answer double, cosine double")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without benchmark items."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
