"""The chain from tokens to clusters, its tables, and operators in blocks."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from textloom.functions.segment import segment
from textloom.operators import relevance, sequences, similarity, synonyms, tfidf
from textloom.plans import catalog, words
from textloom.sources.tables import Tables


def test_chain_writes_all_tables(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    docs = df.select(F.concat_ws("-", "conv_id", "turn").alias("doc"), (F.col("conv_id") % 9).alias("topic"), catalog.low_tokens(df).alias("tokens"))
    settings = words.Settings(w2v_least=-1, least_w2v=-1, min_tf=1)
    found = words.build(docs, f"file://{tmp_path}/t", settings, csv=f"file://{tmp_path}/csv")
    t = Tables(spark, f"file://{tmp_path}/t")
    names = "words w2v_similar term_counts term_stats weights tfidf_similar relevance unrichness features similar_words clusters".split()
    sizes = {name: t.read(name).count() for name in names}
    assert found.columns == ["center_word", "members"] and all(sizes[n] for n in names[:9])
    # the features are of pairs that both searches found, with the trained vectors' cosine and Jaro
    rows = t.read("features").join(t.read("w2v_similar"), ["target_word", "sim_word"]).join(t.read("tfidf_similar").withColumnRenamed("similarity", "s"), ["target_word", "sim_word"])
    assert rows.count() == sizes["features"] and rows.where("w2v <> similarity or jaro <> jaro_sim or tfidf <> s").count() == 0
    marks = t.read("features").select("target_word", "sim_word", (F.crc32("target_word") % 2).cast("int").alias("is_sim")).collect()
    labels = spark.createDataFrame(marks, "target_word string, sim_word string, is_sim int")
    again = words.build(docs, f"file://{tmp_path}/t", settings, labels)
    assert "mdl_pred" in t.read("similar_words").columns and again.columns == found.columns


def test_tables_lock_and_batches(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    one = spark.range(3)
    with Tables(spark, path) as t:
        with pytest.raises(RuntimeError), Tables(spark, path):
            pass
        t.append("rows", one, 0)
        t.append("rows", spark.range(5), 1)
        t.append("rows", spark.range(2), 1)
        assert t.read("rows").count() == 5
        assert t.write("whole", one).count() == 3 and t.write("whole", spark.range(1)).count() == 1
    with Tables(spark, path):
        pass


def test_aligned_vectors(spark):
    df = spark.createDataFrame([([1, 3], [2.0, 1.0], [3, 5], [4.0, 1.0]), (None, None, [2], [1.0])], "a array<int>, x array<double>, b array<int>, y array<double>")
    got = [[tuple(p) for p in r["r"]] for r in df.select(similarity.aligned(F.col("a"), F.col("x"), F.col("b"), F.col("y"), 0.5).alias("r")).collect()]
    assert got == [[(1, 2.0, 0.5), (3, 1.0, 4.0), (5, 0.5, 1.0)], [(2, 0.5, 1.0)]]


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "VECTORS", 20)
    x = np.random.default_rng(3).integers(-2, 3, (130, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [0.0] * 4)], "vec_id long, embedding array<double>")
    got = {}
    for r in similarity.dense_top(df, 5).collect():
        got.setdefault(r["a"], set()).add(r["b"])
    norm = np.linalg.norm(x, axis=1)
    live = np.flatnonzero(norm > 0)
    u = x[live] / norm[live, None]
    for i, k in enumerate(live):
        s = [(-(round(float(c), 9)), int(b)) for b, c in zip(live, u @ u[i], strict=True) if b != k]
        assert len(got[k]) == 5 and {c for c, b in sorted(s)[:5]} == {c for c, b in s if b in got[k]}


def test_folds_and_ranks(spark):
    for n, k in ((0, 3), (2, 5), (17, 5), (20, 5)):
        rows = spark.range(n)
        sizes = [0] * k
        for r in synonyms.split_folds(rows, k, "id").groupBy("fold").count().collect():
            sizes[r["fold"]] = r["count"]
        assert sizes == [n // k + (f < n % k) for f in range(k)]
    got = tfidf.ranked(spark.createDataFrame([("b",), ("ab",), ("a",), ("abc",)], "t string"), F.col("t"), "r").orderBy("r").collect()
    assert [(r["t"], r["r"]) for r in got] == [("a", 1), ("ab", 2), ("abc", 3), ("b", 4)]
    assert sequences.vocabulary(spark.createDataFrame([(["y", "x"],)], "t array<string>"), "t").orderBy("idx").collect()[1]["token"] == "y"


def test_segment_with_flags(spark):
    known = spark.createDataFrame([("ab", "n"), ("ab", "v"), ("c", "a"), (None, "n")], "w string, f string")
    docs = spark.createDataFrame([(1, "abcd"), (2, None)], "i int, text string")
    got = {r["i"]: [tuple(t) for t in r["words"]] for r in segment(docs, known, "w", flag="f").collect()}
    assert got == {1: [("ab", "n"), ("c", "a"), ("d", "x")], 2: []}


def test_flagged_relevance(spark):
    docs = spark.createDataFrame([(1, [("good", "a"), ("shop", "nz"), ("fast", "d"), ("shop", "n")]), (2, [("fast", "v"), ("shop", "nz")])], "doc int, pairs array<struct<word:string,flag:string>>")
    targets = spark.createDataFrame([("fast", 0.7), ("none", 0.1)], "word string, coef double")
    rows = relevance.summary(relevance.flagged_pairs(docs, targets), targets).collect()
    assert [(r["flag_word"], r["target_word"], r["flag_flag"], r["target_flag"], r["total_num"], r["coef"]) for r in rows] == [("shop", "fast", "nz", "d", 2, 0.7)]
    assert rows[0]["sum_relevance"] == pytest.approx(1 + 0.67)


def test_rounds_and_logarithms_are_those_of_sql(spark):
    """Bit for bit, for halves at the last digit and logarithms that F.round and F.log2 give otherwise."""
    import duckdb

    from textloom.functions import text

    con = duckdb.connect()
    rows = spark.range(1, 2001).select(F.col("id"), (F.col("id") * 0.0000005).alias("x"))
    got = {r["id"]: (r["r"], r["l"]) for r in rows.select("id", text.rounded(F.col("x"), 6).alias("r"), tfidf.log2(20 / F.col("id")).alias("l")).collect()}
    want = {k: (r, x) for k, r, x in con.execute("SELECT id, round(id * 0.0000005::DOUBLE, 6), log2(20::BIGINT / id) FROM range(1, 2001) t(id)").fetchall()}
    assert got == want


def test_ranks_by_rounded_values_are_those_of_sql(spark):
    """Halves at the ninth digit of s * s / n fall as in SQL."""
    import duckdb

    each = spark.range(1, 2001).select(F.col("id").alias("doc"), F.col("id").cast("string").alias("flag_word"), F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("x"))
    each = each.select("doc", "flag_word", F.col("x").cast("string").alias("target_word"), F.sqrt((F.col("doc") + F.col("x")) * 0.000000001).alias("each"))
    got = {(int(r["flag_word"]), float(r["target_word"])): r["rank_in_flag_word"] for r in relevance.summary(each).collect()}
    sql = "SELECT id, x, rank() OVER (PARTITION BY id ORDER BY round(s * s / 1, 9) DESC) FROM (SELECT id, x, sqrt((id + x) * 0.000000001::DOUBLE) AS s FROM range(1, 2001) t(id), (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS x))"
    assert got == {(k, x): r for k, x, r in duckdb.connect().execute(sql).fetchall()}


def test_sparse_blocks_meet_quickly_and_exactly():
    """Pairs that cannot reach a term's best so far cost a product in single precision; what stays is that of all pairs in double precision."""
    import time

    rng, n = np.random.default_rng(5), 2048
    rows = []
    for k in range(24):
        x = (rng.random((n, 20)) < 0.5) * rng.random((n, 20))
        x[:40] = 0
        x[:40, k % 3] = 1  # many ties at one
        at, docs = np.nonzero(x)
        rows.append((x, {"size": n, "docs": [f"d{d}" for d in range(20)], "at": at.astype(np.int32).tobytes(), "codes": docs.astype(np.int32).tobytes(), "w": x[at, docs].tobytes()}))
    left, best, began = similarity._Side(rows[5][1], ""), np.full((n, 50), -1, np.int64), time.monotonic()
    for k, (_, row) in enumerate(rows):
        similarity._meet(left, similarity._Side({f"{c}_b": v for c, v in row.items()}, "_b"), k, best, 0.55, 0.5, True)
    assert time.monotonic() - began < 4  # over 7 s while all pairs were ranked in double precision
    got = similarity._ranked(5, best).to_pydict()
    x, y = rows[5][0][::97], np.concatenate([r[0] for r in rows])
    own = (x > 0).sum(axis=1), (y > 0).sum(axis=1)
    shared = (x > 0).astype(float) @ (y > 0).T
    with np.errstate(all="ignore"):
        sim = (x @ y.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1) * 0.5 + 0.5) * np.minimum(shared / (0.5 * np.maximum(own[0][:, None], own[1])), 1)
    sim[(shared == 0) | ~(sim >= 0.55)] = -1
    number = (np.repeat(np.arange(24), n) << similarity.PLACE) + np.tile(np.arange(n), 24)
    found = {}
    for a, b, m in zip(got["a"], got["b"], got["millionths"], strict=True):
        found.setdefault(a, []).append((-m, b))
    for i in range(len(x)):
        m = np.floor(sim[i] * 1_000_000 + 0.5)
        assert sorted(found.get((5 << similarity.PLACE) + 97 * i, [])) == sorted((-int(m[j]), int(number[j])) for j in np.flatnonzero(sim[i] >= 0))[:50]


def test_weights_read_their_counts_once(spark):
    """Texts are tokenized in one job, however often the counts are used."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    docs = spark.range(30).selectExpr("id % 3 AS doc", "array('a' || id % 5) AS tokens").mapInPandas(count, "doc long, tokens array<string>")
    assert tfidf.weights(tfidf.term_counts(docs), 0).count() == 15 and seen.value == 30


def test_dense_blocks_send_on_their_best_only():
    """However many blocks a block meets, it holds n rows of each vector; ties go to the least key."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (3000, 8)).astype(float)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    keys = rng.permutation(len(x))
    best = similarity._Best(keys[:600], x[:600].copy().ravel(), 7)
    for lo in range(0, len(x), 250):
        best.meet(keys[lo : lo + 250], x[lo : lo + 250].copy().ravel())
    got = best.rows().to_pydict()
    assert len(got["a"]) == 600 * 7
    found = {}
    for a, b, s in zip(*got.values(), strict=True):
        found.setdefault(a, []).append((-s, b))
    for i in range(0, 600, 13):
        s = np.einsum("ij,ij->i", np.repeat(x[i : i + 1], len(x), axis=0), x)
        assert found[keys[i]] == sorted((-v, k) for v, k in zip(s, keys, strict=True) if k != keys[i])[:7]


def test_jaro_of_many_pairs_at_once():
    """Matches and transpositions as by the definition, pair by pair, for strings of all lengths in few passes."""
    from textloom.functions import jaro

    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcé𝄞"), rng.integers(1, 30)))
    one, two = [word() for _ in range(600)], [word() for _ in range(600)]
    for least in (None, 1.0, 3.0):
        got = jaro.places(one, two, least)
        for k, (a, b) in enumerate(zip(one, two, strict=True)):
            window, used = max(max(len(a), len(b)) / 2 - 1, -9 if least is None else least), []
            for i, c in enumerate(a):
                used += [j for j, x in enumerate(b) if x == c and abs(i - j) <= window and j not in used][:1]
            assert (got[0][k], got[1][k]) == (len(used), sum(b[x] != b[y] for x, y in zip(used, sorted(used), strict=True)) / 2)
