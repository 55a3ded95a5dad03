"""Near copies, decontamination and URL lists do the whole job: no pairs, words, prefixes or windows are left out."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, neardup, urlfilter


def corpus(seed, common, rare):
    rng = random.Random(seed)
    made = list({"".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(common + rare)})
    return rng, lambda n, share: [rng.choice(made[:common]) if rng.random() < share else rng.choice(made[common:]) for _ in range(n)]


def leaked(spark, docs, items):
    got = decontaminate.leaks(spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string").repartition(4), spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_short_items_between_known_words(spark):
    """Every word of the documents is in the benchmark, so that the text around a short item is as near to other items."""
    rng, draw = corpus(1, 1, 3000)
    items = [(k, draw(rng.randint(5, 15), 0)) for k in range(1500)]
    docs = [(k, draw(rng.randint(40, 90), 0) + items[k][1] + draw(50, 0)) for k in range(300)] + [(9000 + k, draw(120, 0)) for k in range(100)]
    got = leaked(spark, docs, items)
    assert not {(k, k) for k in range(300)} - got
    assert sum(d >= 9000 for d, _ in got) <= 5  # of 150,000 pairs, by chance


def test_hot_paraphrases(spark):
    """A third of all rows holds an item of which another six words are replaced each time."""
    rng, draw = corpus(2, 50, 4000)
    item, fixed = draw(30, 0.2), set(range(1, 30, 5))
    docs = [(k, draw(40, 0.5) + [draw(1, 0)[0] if i in fixed else w for i, w in enumerate(item)] + draw(30, 0.5)) for k in range(100)] + [(9000 + k, draw(100, 0.5)) for k in range(200)]
    assert leaked(spark, docs, [(1, item), (2, draw(30, 0.5))]) == {(k, 1) for k in range(100)}


def test_long_item_of_common_words(spark):
    rng, draw = corpus(3, 100, 6000)
    item = draw(2000, 0.8)
    docs = [(1, draw(500, 0.5) + item + draw(500, 0.5))] + [(9000 + k, draw(400, 0.8)) for k in range(100)]
    assert leaked(spark, docs, [(1, item), (2, draw(30, 0.5))]) == {(1, 1)}


def test_url_entries_at_any_depth(spark):
    parent = ".".join("abcdefghij") + ".example.com"
    entries = spark.createDataFrame([("bad", "host.org/a/b/c/d", "2020-01-01", "add"), ("bad", parent, "2020-01-01", "add")], "list string, key string, day string, action string").withColumn("day", F.to_date("day"))
    rows = [(1, "https://host.org/a/b/c/d/e.html?q=1"), (2, f"https://www.{parent}/"), (3, "https://host.org/a/b/c/dd"), (4, "https://example.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("fetched", F.to_date(F.lit("2021-01-01")))
    assert {r["page_id"]: r["n_active"] for r in urlfilter.judge(pages, entries).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_hot_group_loses_no_link(spark, monkeypatch):
    """One cell holds all documents, each near one other and below the bound to the rest: every similar pair is in one class."""
    sign = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: sign(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))
    rng, draw = corpus(5, 2000, 10)
    root, docs = draw(200, 1), []

    def edited(words, n):
        at = set(rng.sample(range(5, 195), n))
        return [f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]

    for k in range(0, 400, 2):
        one = edited(root, 5)
        docs += [(k, " ".join(one)), (k + 1, " ".join(edited(one, 2)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = dict(neardup.near_duplicates(df).collect())
    weights = neardup.idf_weights(df)
    of, ids, n = neardup.weighted(*neardup.flat(pa.array([t for _, t in docs])))
    assert n.max() == 1
    known, at = np.unique(ids, return_inverse=True)
    there = np.zeros((len(docs), len(known)))
    there[of, at] = 1
    w = weights[(known & np.uint64((1 << neardup.DF_BITS) - 1)).astype(int)].astype(float)
    low, total = (there * w) @ there.T, there @ w
    x, y = np.nonzero(np.triu(low / (total[:, None] + total[None] - low) >= neardup.SIMILAR, 1))
    assert len(x) > 100 and len(set(got.values())) > 100
    assert sum(got[i] != got[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)) == 0


def test_pipeline_stage_of_a_hot_group(spark, monkeypatch):
    """The pipeline's stage keeps one document of each near pair of a cell that holds all documents."""
    sign = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: sign(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))
    rng, draw = corpus(8, 3000, 1)
    root, docs = draw(100, 1), []
    for k in range(0, 120, 2):
        one = root + draw(60, 1)
        docs += [(k, " ".join(one)), (k + 1, " ".join([*one[:-1], f"x{k}"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in neardup.stage(spark, df, "").select("doc_id").collect()) == list(range(0, 120, 2))


@pytest.mark.parametrize("n", [4, 12, 24])
def test_samples_drop_no_candidates(spark, monkeypatch, n):
    """Samples that agree nowhere only put a comparison off: the two near copies of a cell are one class, whether its pairs are compared all at once, one by one or in blocks."""
    sign = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: sign(*a).withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("samples", F.transform("samples", lambda _: F.col("id").cast("int"))))
    _, draw = corpus(8, 2000, 10)
    docs = [(k, " ".join(draw(100, 1))) for k in range(n - 1)]
    docs.append((n - 1, docs[1][1] + " more"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert dict(neardup.near_duplicates(df).collect()) == {k: k if k < n - 1 else 1 for k in range(n)}
    assert {r["doc_id"] for r in neardup.stage(spark, df, "").collect()} == set(range(n - 1))


@pytest.mark.parametrize("scarce", [0, 1 / 128, 1])
def test_block_similarities_as_plain_loops(monkeypatch, scarce):
    monkeypatch.setattr(neardup, "SCARCE", scarce)
    monkeypatch.setattr(neardup, "HELD", 1000)
    rng, draw = corpus(6, 60, 1)
    root = draw(100, 1)
    texts = [" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(99)}" for w in root) for _ in range(40)] + ["a " * 12, "a " * 8, "", "z"]
    idf = (1 + np.random.default_rng(0).random(1 << neardup.DF_BITS)).astype(np.float32)
    bags = [{} for _ in texts]
    for o, i, c in zip(*neardup.weighted(*neardup.flat(pa.array(texts))), strict=True):
        bags[o][int(i)] = c * float(idf[int(i) & ((1 << neardup.DF_BITS) - 1)])
    left, right = np.arange(20), np.arange(15, len(texts))
    got = neardup.shared_weights(pa.array(texts), left, right, idf)
    for x, i in enumerate(left):
        for y, j in enumerate(right):
            low = sum(min(v, bags[j].get(g, 0)) for g, v in bags[i].items())
            assert got[x, y] == pytest.approx(low / max(sum(bags[i].values()) + sum(bags[j].values()) - low, 1e-12))


def test_latent_basis_of_all_documents(spark):
    """The basis diagonalises the passages of all documents and the items, which weigh as much as they."""
    rng, draw = corpus(7, 80, 1)
    texts, items = [draw(rng.randint(1, 150), 1) for _ in range(50)], [draw(40, 1) for _ in range(5)]
    every = sorted({w for t in texts + items for w in t})
    raw, offs = decontaminate.flat(pa.array(every))
    h = decontaminate._hashes(raw, offs)[0]
    order = np.argsort(h)
    place, idf = {every[k]: j for j, k in enumerate(order)}, 1 + np.random.default_rng(1).random(len(every))
    index = decontaminate.Index(h[order], idf, [(k, np.array([place[w] for w in t])) for k, t in enumerate(items)])

    def plain(rows):
        out = np.zeros((len(every), len(every)))
        for t in rows:
            for k in range(0, len(t), decontaminate.BLOCK):
                p = np.zeros(len(every))
                for w in t[k : k + 2 * decontaminate.BLOCK]:
                    p[place[w]] += idf[place[w]]
                out += np.outer(p, p)
        return out, sum(2 * idf[place[w]] ** 2 for t in rows for w in t)

    (a, ea), (b, eb) = plain(texts), plain(items)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, t string").repartition(3)
    decontaminate._fit(docs, index, [" ".join(t) for t in items])
    small = index.basis.T.astype(float) @ (a + b * (ea / eb)) @ index.basis
    assert np.abs(small - np.diag(np.diag(small))).max() < 1e-4 * small.max()
    assert decontaminate._product(docs.limit(0), index, index.basis)[1] == 0


@pytest.mark.parametrize(("many", "cells"), [(255, 1 << 22), (2, 1 << 22), (255, 200)])
def test_candidates_as_plain_counts(monkeypatch, many, cells):
    """Windows are compared with an item if they have half of its words, each as often as the item at most, and no others are."""
    monkeypatch.setattr(decontaminate, "MANY", many)
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    rng, draw = corpus(9, 60, 1)
    items = [draw(rng.randint(1, 30), rng.random()) + ["w0"] * rng.choice([0, 5, 20]) for _ in range(30)]
    texts = [draw(rng.randint(0, 300), rng.random()) + rng.choice([[], ["w0"] * 9, *items]) for _ in range(20)]
    every = sorted({w for t in items for w in t})
    h = decontaminate._hashes(*decontaminate.flat(pa.array(every)))[0]
    order = np.argsort(h)
    place = {every[k]: j for j, k in enumerate(order)}
    index = decontaminate.Index(h[order], np.ones(len(h)), [(k, np.array([place[w] for w in t])) for k, t in enumerate(items)])
    strides = decontaminate._strides(index, np.array([len(t) for t in items]), np.zeros(len(h), bool))
    term, block, _, doc = decontaminate._tokens(*decontaminate.flat(pa.array([" ".join(t) for t in texts])), decontaminate.Lookup(index.vocab))
    got, plain = set(), set()
    for stride, postings in strides:
        for first, last, j in decontaminate._candidates(term, block, doc, stride, postings):
            got |= set(zip(first.tolist(), last.tolist(), j.tolist(), strict=True))
        for d in range(len(texts)):
            own = np.flatnonzero(doc == d)
            for lo in own[::stride].tolist():
                hi = min(lo + 2 * stride, int(own[-1]) + 1)
                there = Counter(texts[d][(lo - own[0]) * decontaminate.BLOCK : (hi - own[0]) * decontaminate.BLOCK])
                plain |= {(lo, hi, j) for j in postings[0].tolist() if 2 * (Counter(items[j]) & there).total() >= len(items[j])}
    assert plain and (got == plain if many == 255 else got >= plain)


@pytest.mark.parametrize("piece", [2, 3, 32])
def test_sums_of_runs(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = np.random.default_rng(2)
    rows, n = rng.integers(0, 9, (50, 4)).astype(np.float32), np.r_[rng.integers(1, 9, 30), 200, 1]
    at, head = rng.integers(0, 50, n.sum()), np.cumsum(n) - n
    assert np.array_equal(decontaminate._sums(rows, at, head), np.add.reduceat(rows[at], head, axis=0))
