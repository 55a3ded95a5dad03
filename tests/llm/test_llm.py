"""Training-data operators against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, compare
from pyspark.sql import functions as F

from textloom.llm import base, decontaminate, embeddings, fixity, langid, neardup, pieces, queries, repeats, suffixes, tokens, toxicity, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_bytes", F.lit("x")).withColumn("score", F.lit(3)).withColumn("ids", F.lit(1)).withColumn("class_id", F.lit(9)) if extra else df


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "to", "re", "in", "es", "or", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "  lead  and trail  "), (6, "▁ ▁a<s>é字\n\t 🙂"), (7, "x" * 5000), (8, "x" * 5000), (9, "… !!! …"), (None, "no id")]


# ---- base -----------------------------------------------------------------------------------------------------------


def test_words_and_shingles():
    raw, offs = base.flat(pa.array(["ab c", None, "d", "c ab c ab c ab"]))
    s, e, first = base.words(raw, offs)
    assert [raw[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == "ab c d c ab c ab c ab".split() and first.tolist() == [0, 2, 2, 3, 9]
    h, of = base.shingles(raw, offs, 5)
    assert of.tolist() == [0, 2, 3, 3]


@pytest.mark.parametrize("at_once", [1 << 20, 0])
def test_components(spark, at_once, monkeypatch):
    monkeypatch.setattr(base, "AT_ONCE", at_once)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (7, 7)]
    got = {r["node"]: r["component"] for r in base.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges[:-2]:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for a, b in edges[:-2] if a != b for x in (a, b)}
    assert base.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 --------------------------------------------------------------------------------------------------------------


def jaccard(a, b, df, n):
    """Weighted Jaccard similarity with plain dictionaries."""

    def bag(t):
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        out = {}
        for k in range(max(1, len(w) - 4)):
            out[tuple(w[k : k + 5])] = out.get(tuple(w[k : k + 5]), 0) + 1
        return {k: v * max(1, 1 + np.log((n + 1) / (df.get(k, 1) + 1)) / np.log(n + 1)) for k, v in out.items()}

    a, b = bag(a), bag(b)
    low = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows = list(ODD)
    one, two = prose(rng, 200), prose(rng, 200)
    for k in range(40):  # near copies, each with an edit of its own
        w = one.split()
        w[rng.randrange(200)] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, two) for k in range(30)] + [(400 + k, prose(rng, 150)) for k in range(40)]
    half = two.split()[:100]
    rows.append((500, " ".join(half) + " " + prose(rng, 100)))  # half of another text: not near
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, rows, True).repartition(6)).collect()}
    assert len(got) == len({i for i, _ in rows if i is not None})
    assert {got[100 + k] for k in range(40)} == {100} and {got[300 + k] for k in range(30)} == {300}
    assert all(got[400 + k] == 400 + k for k in range(40)) and got[500] == 500 and got[8] == 7
    assert all(got[i] == i for i in (1, 2, 3, 4, 5, 6, 7, 9))
    assert neardup.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_as_all_pairs(spark):
    """Every pair of weighted Jaccard similarity >= 0.8 of the given documents and of a hot group of near copies in one class; classes are what such pairs join."""
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    root = prose(rng, 150).split()
    for k in range(150):  # a hot group around one text; most of its pairs are below the bound
        rows.append((10_000 + k, " ".join(w if rng.random() > rng.choice((0.005, 0.02, 0.05)) else f"x{rng.randrange(10**6)}" for w in root)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, rows).repartition(5)).collect()}
    bags, df = {}, {}
    for i, t in rows:
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        bag = {}
        for k in range(max(1, len(w) - 4) if w else 0):
            bag[tuple(w[k : k + 5])] = bag.get(tuple(w[k : k + 5]), 0) + 1
        bags[i] = bag
        for g in bag:
            df[g] = df.get(g, 0) + 1
    n = sum(bool(b) for b in bags.values())
    weight = {g: max(1, 1 + np.log((n + 1) / (c + 1)) / np.log(n + 1)) for g, c in df.items()}
    total = {i: sum(v * weight[g] for g, v in b.items()) for i, b in bags.items()}
    near, up, ids = [], {i: i for i, _ in rows}, [i for i, _ in rows if bags[i]]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, i in enumerate(ids):
        for j in ids[:x]:
            low = sum(min(v, bags[j][g]) * weight[g] for g, v in bags[i].items() if g in bags[j])
            if low / (total[i] + total[j] - low) >= 0.8:
                near.append((i, j))
                a, b = sorted((find(i), find(j)))
                up[b] = a
    together = sum(got[i] == got[j] for i, j in near) / len(near)
    assert len(near) > 300 and together >= 0.98 and all(find(i) == find(c) for i, c in got.items())


def test_keys_with_several_texts(spark):
    rng = random.Random(13)
    one, two = prose(rng, 80), prose(rng, 80)
    rows = [(1, one), (2, one), (3, one), (3, two), (4, two), (5, None), (5, None)]
    first, again = ({r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, rows).repartition(n)).collect()} for n in (1, 7))
    assert first == again and len(first) == 5 and first[2] == 1 and first[4] in (3, 4) and first[3] in (1, 3) and first[5] == 5


def test_verified_similarity(spark):
    rng = random.Random(3)
    a = prose(rng, 120)
    texts = [a] + [" ".join(w if rng.random() > q else "zz" for w in a.split()) for q in (0.01, 0.03, 0.1)]
    rows = docs_of(spark, list(enumerate(texts)))
    weights = spark.sparkContext.broadcast(neardup.idf_weights(rows))
    df = {}
    for t in texts:
        w = t.split()
        for g in {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            df[g] = df.get(g, 0) + 1
    pairs = spark.createDataFrame([(0, k, texts[0], texts[k]) for k in (1, 2, 3)], "a long, b long, ta string, tb string")
    for r in neardup._verify(pairs, weights).collect():
        assert r["similar"] == pytest.approx(jaccard(texts[0], texts[r["b"]], df, 4), abs=0.01)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    ids, w = base.mix(np.arange(1, 1001, dtype=np.uint64)) >> np.uint64(12), rng.uniform(1, 3, 1000).astype(np.float32)
    sample, got = neardup.Sampler(), []
    a, b = sample(ids[:800], np.log(w[:800]), np.array([0]))[0], sample(ids[200:], np.log(w[200:]), np.array([0]))[0]
    got = (a == b).mean()
    want = w[200:800].sum() / w.sum()
    assert abs(got - want) < 0.25


# ---- 2 --------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    got = langid.op2_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 200 and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    model = langid.learn(spark.read.parquet(f"{SMALL}/documents.parquet"))
    odd = {r["doc_id"]: r for r in langid.identify(docs_of(spark, ODD + [(20, "qzx" * 200)], True), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["rejected"] and odd[i]["score"] == 0 for i in (1, 2, 3, 9)) and odd[4]["lang_pred"] in model.langs and odd[20]["rejected"]
    none = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(docs_of(spark, [(1, "some text")]), none).collect()[0]["lang_pred"] == "und"


def plain_kneser_ney(texts):
    """Probability of a character after three others with plain dictionaries."""
    counts = {4: {}, 3: {}, 2: {}, 1: {}}
    for t in texts:
        w = "\0\0\0" + re.sub("[^a-z]+", " ", t.lower())
        for k in range(3, len(w)):
            counts[4][w[k - 3 : k + 1]] = counts[4].get(w[k - 3 : k + 1], 0) + 1
    for n in (3, 2, 1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / langid.ALPHABET
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones and twos else 0.5
        after = [c for x, c in counts[n].items() if x[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        return max(counts[n].get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

    return p


def test_kneser_ney_as_plain_counts(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 40)  # ranges when scoring; counting below takes whole texts
    one, two = ["the cat and the hat sat on the mat", "a cat, the rat. and that!a"], ["der hund und die katze", "das haus und der baum"]
    models = []
    for lang, texts in (("b", two), ("a", one)):
        m = langid.fit(*langid.count(texts), lang)
        m.limit = np.array([9.0])
        models.append(m)
    both = langid.join(models)
    langid._fill(both, np.concatenate([langid.count(x)[0] for x in (one, two)]))
    asked = ["the hat and the dog on a haus und zebra the cat", "x", "katze " * 30]
    h, n = langid.entropies(both, asked)
    for k, texts in enumerate((one, two)):
        p = plain_kneser_ney([x[i : i + 40] for x in texts for i in range(0, len(x), 40)])
        for j, t in enumerate(asked):
            w = "\0\0\0" + re.sub("[^a-z]+", " ", t)
            want = -np.mean([np.log(p(w[i - 3 : i + 1])) for i in range(3, len(w))])
            assert n[j] == len(w) - 3 and h[j, k] == pytest.approx(want, rel=1e-4)


def test_language_columns_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(7)).withColumn("lid_x", F.lit(1)).withColumn("n_removed", F.lit(5)).withColumn("kept_text", F.lit("own"))
    got = langid.stage(spark, docs, SMALL)
    assert got.columns == docs.columns and got.where("score = 'own' and lang_pred = 7 and lid_x = 1").count() == got.count() > 150
    cut = repeats.stage(spark, docs, SMALL)
    assert cut.columns == docs.columns and cut.where("n_removed = 5 and kept_text = 'own'").count() == 200


# ---- 3 --------------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cover[k : k + 100] = True
            seen.add(b[k : k + 100])
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out[i] = (len(b), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "sample", "least"), [(1 << 20, 16, 64), (300, 16, 64), (300, 1, 1), (1 << 20, 1, 1)])
def test_repeats(spark, hot, sample, least, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SAMPLE", sample)  # with 1 and 1 the anchors of the passages are common ones
    monkeypatch.setattr(repeats, "LEAST", least)
    rng = random.Random(4)
    common = "".join(rng.choice("ab é") for _ in range(300))
    rows = [r for r in ODD if r[0] is not None] + [(50 + k, prose(rng, 30) + common[:150] + prose(rng, 30)) for k in range(20)]
    rows += [(80, common), (81, "a" * 350), (82, "ab" * 200 + common), (83, common[:99]), (84, common[:100]), (90, prose(rng, 40) * 3)]
    rows += [(200 + k, prose(rng, 8) + common[k % 7 : 110 + k % 50] + prose(rng, 8)) for k in range(60)]  # many ways around one core
    rows += list(zip((300, 301, 302), (*parity(1024), parity(1024)[0]), strict=True))
    got = repeats.remove_repeats(docs_of(spark, rows, True).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0
    assert repeats.remove_repeats(docs_of(spark, [(None, common), (1, common)])).agg(F.sum("n_removed")).collect()[0][0] == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = np.r_[rng.integers(1, 1 + rng.integers(1, 4), rng.integers(1, 60)), 0].astype(np.uint8)
        sa, b = suffixes.suffix_array(t), t.tobytes()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: b[i:])
        p = suffixes.permuted_prefixes(t, sa, 1)
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            assert p[i] == next(k for k in range(99) if t[i + k] != t[j + k] or t[i + k] <= 1)


def test_long_text_in_pieces(spark):
    """One text of several pieces, and strings that lie across their borders."""
    rng = random.Random(14)
    part = prose(rng, 200)
    text = (prose(rng, 30_000)[: repeats.CHUNK - 60] + part + prose(rng, 100_000))[: 3 * repeats.CHUNK - 50] + part
    rows = [(1, text), (2, part[:130])]
    got = repeats.remove_repeats(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


# ---- 4, 8 -----------------------------------------------------------------------------------------------------------


def test_tokens_and_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    parts = [" ", "  ", "a", "é", "\n", "<s>", "▁", "字", "the", "##", "12"]
    rows = ODD + [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    df = docs_of(spark, rows, True).repartition(3)
    want = sorted((t or "", sp.encode(t or "")) for _, t in rows)
    assert sorted((r["text"] or "", r["ids"]) for r in pieces.encode(df, MODEL).collect()) == want
    n = tokens.count_tokens(df, MODEL, keep=("text",)).collect()
    assert sorted((r["text"] or "", r["n_tokens"], r["n_bytes"]) for r in n) == sorted((t, len(i), len(t.encode())) for t, i in want)
    back = pieces.decode(pieces.encode(df, MODEL, check="same"), MODEL).collect()
    assert all(r["same"] and r["decoded"] == (r["text"] or "").replace("▁", " ") for r in back)
    assert pieces.encode(docs_of(spark, []), MODEL).count() == 0 and tokens.count_tokens(docs_of(spark, []), MODEL).count() == 0


def parity(n):
    """Two different texts of a and b that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_units_of_one_hash(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    one, two = parity(1024)
    raw, offs = base.flat(pa.array([one, two]))
    key = tokens.unit_keys(raw, offs[:-1], offs[1:])
    assert key[0] == key[1]  # else this test shows nothing
    for rows in ([(1, one), (2, two)], [(1, one + " x"), (2, "y"), (3, "z " + two), (4, two), (5, one)]):
        df = docs_of(spark, rows).coalesce(1)
        want = {i: sp.encode(t) for i, t in rows}
        assert {r["doc_id"]: r["ids"] for r in pieces.encode(df, MODEL, check="same").where("same").collect()} == want
        assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, MODEL).collect()} == {i: len(x) for i, x in want.items()}
    units = tokens.Units()  # one batch after the other: memory is asked by bytes too
    for t in (one, two, one):
        raw, offs = base.flat(pa.array([t]))
        assert tokens._count_units(raw, offs, sp, units).tolist() == [len(sp.encode(t))]


def test_clashing_names(spark):
    rows = [(1, "a text of words", "x"), (2, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string").withColumn("__ids", F.lit(1)).withColumn("t", F.lit(2)).withColumn("id", F.lit(3))
    got = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert [(r["doc_id"], r["__text"], r["decoded"], r["__ids"]) for r in sorted(got)] == [(1, "x", "a text of words", 1), (2, "y", "", 1)]
    assert {r["doc_id"]: r["__text"] for r in tokens.count_tokens(df, MODEL, keep=("doc_id", "__text")).collect()} == {1: "x", 2: "y"}


def test_long_texts_are_cut(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    sp, _ = tokens._sentencepiece(MODEL)
    raw = np.frombuffer(("  some  words here and there " * 20).encode(), np.uint8)
    parts = list(tokens._pieces(raw, np.array([0, len(raw)])))
    assert len(parts) > 3
    known = tokens.Units()
    n = sum(int(tokens._count_units(r[1:] if k else r, o - (k > 0) * np.array([0, 1]), sp, known)[0]) for k, (r, o) in enumerate(parts))
    assert n == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(raw.tobytes().decode()))


# ---- 5 --------------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(20)]
    put = lambda t: text(100) + " " + t + " " + text(60)
    drop = lambda t: " ".join(w if rng.random() > 0.2 else word() for w in t.split())
    rows = ODD + [(100 + k, put(items[k][1].upper())) for k in range(20)] + [(200 + k, put(drop(items[k][1]))) for k in range(20)] + [(300 + k, text(200)) for k in range(40)]
    bench = spark.createDataFrame(items + [(50, None), (None, "x y z")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, rows, True).repartition(4), bench).collect()}
    assert {(100 + k, k) for k in range(20)} <= got and sum((200 + k, k) in got for k in range(20)) >= 18 and not any(d >= 300 or d < 100 for d, _ in got)
    assert decontaminate.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0 and decontaminate.leaks(docs_of(spark, []), bench).count() == 0


def test_common_subsequence():
    def plain(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(best[j] + 1 if x == y else max(now[j], best[j + 1]))
            best = now
        return best[-1]

    rng = random.Random(16)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate.masks(a), len(a), b) == plain(a, b)


# ---- 6, 7 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name])


def test_fixity(spark, tmp_path):
    rows = [("f", k, 10 * k, f"record {k}") for k in range(600)] + [("g", 0, 0, None)]
    a = spark.createDataFrame(rows, "file string, seq long, pos long, record string")
    b = a.where("seq <> 77").withColumn("record", F.when(F.col("seq") == 300, "broken").otherwise(F.col("record"))).unionByName(spark.createDataFrame([("f", 600, 9000, "more"), (None, 1, 1, "x")], a.schema))
    assert sorted((r["seq"], r["state"]) for r in fixity.audit(a, b).collect()) == [(77, "missing on the right"), (300, "changed"), (600, "missing on the left")]
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), a.limit(0)).count() == 0
    one = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n".encode()
    (tmp_path / "x.warc").write_bytes(one * 3)
    assert [(r["seq"], r["pos"]) for r in fixity.read_warc(spark, str(tmp_path)).orderBy("seq").collect()] == [(k, k * len(one)) for k in range(3)]


def test_fixity_shuffles_pages_once(spark, tmp_path):
    rng = random.Random(6)
    odd = [(None, "u", "no id"), (7, "b", "second by url"), (7, "a", "first by url é"), (7, "a", "z"), (102, None, "no url"), (11, "u", "gone"), (203, "u", None), (396, None, None), (1005, "u", "")]
    rows = odd + [(2000 + k, f"u{k}", rng.randbytes(4000).hex()) for k in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))

    def stages():
        none = spark._jvm.java.util.ArrayList()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    got = fixity.op6_fixity_audit(spark, str(tmp_path)).orderBy("file", "seq").collect()
    assert sum(n for k, n in stages().items() if k not in before) < 1.5 * sum(len(html or "") for _, _, html in rows)

    good = fixity.pack(spark.read.parquet(str(tmp_path / "pages.parquet")))
    text, page = F.col("record"), F.col("page_id")
    hurt = F.when(page % 97 == 5, F.concat(F.lit("w"), F.substring(text, 2, 1 << 30))).when(page % 389 == 7, F.substring(text, 1, 40)).otherwise(text)
    assert got == fixity.audit(good, good.where(page % 499 != 11).withColumn("record", hurt)).orderBy("file", "seq").collect()
    assert {(r["file"][-2:], r["seq"], r["state"]) for r in got} >= {("00", 0, "changed"), ("00", 1, "missing on the right"), ("00", 2, "changed"), ("00", 4, "changed")}


def test_damaged_warc(spark, tmp_path):
    import gzip

    one = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bad = b"WARC/1.1\r\nContent-Length: -9\r\n\r\nhello\r\n\r\n"
    odd = b"WARC/1.1\r\nContent-Length: five\r\n\r\nhello\r\n\r\n"
    files = {"plain": one + bad + odd + one, "zip": gzip.compress(one) + gzip.compress(one + one), "broken": gzip.compress(one) + b"\x1f\x8bnonsense", "cut": one + one[:20], "none": b"", "noise": b"\x00\xff" * 9}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in fixity.read_warc(spark, str(tmp_path)).orderBy("file", "seq").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["pos"], bytes(r["record"])))
    assert [len(got.get(k, [])) for k in files] == [4, 3, 2, 2, 0, 1]
    for name, rows in got.items():
        assert [p for p, _ in rows] == [sum(len(x) for _, x in rows[:k]) for k in range(len(rows))], name
    assert b"".join(x for _, x in got["plain"]) == files["plain"] and got["broken"][1][1] == b"\x1f\x8bnonsense"


def test_url_filter(spark):
    entries = spark.createDataFrame([("ads", "example.com", "2020-01-01", "add"), ("ads", "example.com", "2020-06-01", "remove"), ("bad", "a.example.com/x", "2020-03-01", "add"), ("bad", None, "2020-01-01", "add"), ("ads", "example.com", "2020-02-01", "add")], "list string, key string, day string, action string").withColumn("day", F.to_date("day"))
    rows = [(1, "https://a.example.com/x/y", "2020-04-01"), (2, "http://u@EXAMPLE.com:80", "2020-06-01"), (3, "http://b.example.com.", "2020-05-31"), (4, None, "2020-04-01"), (5, "junk", "2020-04-01"), (6, "http://example.com", None), (7, "http://myexample.com/", "2020-04-01"), (8, "http://a.example.com/x", "2019-12-31"), (None, "http://example.com/", "2020-02-02")]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("lists", F.lit(1))
    got = {r["page_id"]: (r["n_active"], r["lists"], r["blocked"]) for r in urlfilter.judge(pages, entries).collect()}
    free = (0, [], False)
    assert got == {1: (2, ["ads", "bad"], True), 2: free, 3: (1, ["ads"], True), 4: free, 5: free, 6: free, 7: free, 8: free, None: (1, ["ads"], True)}
    assert urlfilter.judge(pages.limit(0), entries).count() == 0 and urlfilter.judge(pages, entries.limit(0)).where("blocked").count() == 0


# ---- 9 --------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 16))
    x[100:140] = x[100] + rng.standard_normal((40, 16)) * 0.12
    x[200:230] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, 2.0]), (905, [None] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df.unionByName(df.limit(5))).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(400)
    while not np.array_equal(new := np.array([label[near[i]].min() for i in range(400)]), label):
        label = new
    assert {i: got[i] for i in range(400)} == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(400)}
    assert all(got[i] == (0, i) for i in range(900, 906)) and len(got) == 406
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_ask_near_shards(spark, monkeypatch):
    """With many shards a vector asks a few of them, and all links come back: of pairs just above the bound, of a hot group in several shards, and of copies."""
    monkeypatch.setattr(embeddings, "SHARD", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:1400] = embeddings._turned(x[:400], 0.951, 1)
    x[1500:1700] = x[1500] + rng.standard_normal((200, 64)) * 0.02
    x[1900:1920] = x[1900]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    routed = embeddings._routed(df.selectExpr("vec_id as rep", "1L as copies", "embedding as v"), 64, 3000, 0.95)
    shards, asked = routed.selectExpr("max(shard) + 1", "sum(size(asks))").collect()[0]
    assert shards >= 46 and asked < 3000 * shards / 5
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = dict(embeddings.near_duplicates(df).select("vec_id", "n_links").collect())
    found = np.array([got[i] for i in range(3000)])
    assert (found <= true).all() and found.sum() >= 0.995 * true.sum() and found[1000:1400].sum() >= 0.98 * true[1000:1400].sum()


# ---- 10 -------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        rows.append((k, prose(rng, 60) + (" nasty word " if bad else " kind word ") + prose(rng, 10)))
        marks.append((k, int(bad)))
    labels = spark.createDataFrame(marks + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    w, b = toxicity.learn(docs_of(spark, rows[:400]), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, rows[400:] + [(9000, None), (9001, "")], True), w, b).collect()}
    assert np.mean([got[k]["predicted"] == y for k, y in marks[400:]]) > 0.95 and got[9000]["score"] == got[9001]["score"] and 0 <= got[9000]["score"] <= 1
    w, b = toxicity.learn(docs_of(spark, rows), labels.limit(0))
    assert not w.any() and b < 0


def test_ftrl_as_plain_loops():
    rng = random.Random(10)
    rows = [(np.unique([rng.randrange(30) for _ in range(rng.randint(1, 9))]), int(rng.random() < 0.3)) for _ in range(60)]
    model = toxicity.fit(rows)
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == 1 << toxicity.BITS else toxicity.L1_A_DOC * len(rows)
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - (1 if v > 0 else -1) * l1) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for f, y in rows:
            at = [*f.tolist(), 1 << toxicity.BITS]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    at = np.arange((1 << toxicity.BITS) + 1)
    got = dict(zip(at.tolist(), model.weights(at).tolist(), strict=True))
    assert all(got[i] == pytest.approx(weight(i), abs=1e-9) for i in [*range(30), 1 << toxicity.BITS]) and sum(v != 0 for v in got.values()) > 5


def test_toxicity_of_odd_tables(spark):
    rows = [(f"k{k}", "nasty word" if k % 2 else "kind word") for k in range(40)] * 2
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("__low", F.lit("x")).withColumn("predicted", F.lit("y"))
    labels = spark.createDataFrame([(f"k{k}", k % 2) for k in range(40)], "doc_id string, toxic int")
    once, again = (toxicity.learn(df.repartition(n), labels) for n in (1, 5))
    assert np.array_equal(once[0], again[0]) and once[1] == again[1]
    got = toxicity.score(df, *once)
    assert got.columns == ["doc_id", "text", "__low", "score", "predicted"] and got.where("__low = 'x'").distinct().count() == 40
    assert toxicity.score(df.limit(0), *once).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = corpus_pipeline.run(spark, SMALL)
    kept = {r["doc_id"] for r in got.collect()}
    assert got.columns == ["doc_id", "n_tokens", "round_trip", "ids"] and len(corpus_pipeline.STAGES) == 5
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert kept <= {i for i, c in classes.items() if i == c} and len(kept) >= len({i for i, c in classes.items() if i == c} - leaked)


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns named as results, and an empty table through every stage; the columns of documents come out again."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(60).unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(3).withColumn("text", F.lit(""))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("ids", "score", "lang_pred", "n_bytes", "class_id", "cosine", "__text", "id", "t", "rejected"):
        odd = odd.withColumn(name, F.lit("own"))
    odd.write.parquet(f"{tmp_path}/odd")
    for table in (spark.read.parquet(f"{tmp_path}/odd"), spark.read.parquet(f"{tmp_path}/odd").limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, table, SMALL)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert got.columns == table.columns, name
                assert got.where("score <> 'own' or n_bytes <> 'own' or ids <> 'own'").count() == 0, name
            n = got.count()
            assert n <= table.count() and (n > 0) == (table.count() > 0), name


def test_long_text_through_shingles_and_letters(spark):
    """Texts of many pieces give what they give in one."""
    rng = random.Random(15)
    text = prose(rng, 3000)
    raw, offs = base.flat(pa.array([text]))
    s, e, _ = base.words(raw, offs)
    whole = base.run_hashes(raw, s, e)
    keep = base.HASHED
    try:
        base.HASHED = 64
        base._powers.cache_clear()
        assert np.array_equal(base.run_hashes(raw, s, e), whole)
    finally:
        base.HASHED = keep
        base._powers.cache_clear()
    m = langid.fit(*langid.count([text[:2000]]), "x")
    h, n = langid.entropies(m, [text, "b " + text])
    piece = langid.PIECE
    try:
        langid.PIECE = 100
        h2, n2 = langid.entropies(m, [text, "b " + text])
    finally:
        langid.PIECE = piece
    assert np.array_equal(n, n2) and np.allclose(h, h2, rtol=1e-5)
