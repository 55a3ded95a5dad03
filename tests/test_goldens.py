"""Worked examples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import jaro, lcss, text
from textloom.functions.segment import longest
from textloom.operators import clusters, relevance, similarity, sticky, synonyms, tfidf


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("r")).collect()[0]["r"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("s")), s="矿务局12-34路abc9é艺") == ["矿", "务", "局", "12", "34", "路", "abc", "9", "艺"]


def test_clean_up(spark):
    assert one(spark, text.cleaned(F.col("s")), s="为什么不太好怎么不是") == "不好不"


JARO = [
    ("palladio", "palladium", 0.8842592593, 0.8923611111, 0.8263888889, 0.7777777778, 0.8252506870, 10, 0.01, 0.8374831389),
    ("宾格binger", "宾格瑞bingerui", 0.9090909091, 0.9272727273, 0.8636363636, 0.7272727273, 0.8552578344, 3, 0.1, 0.8842062675),
    ("binger", "bingerui", 0.9166666667, 0.9266666667, 0.8750000000, 0.7500000000, 0.8674177451, 7, 0.02, 0.8833276157),
]


@pytest.mark.parametrize("row", JARO)
def test_jaro(spark, row):
    s1, s2, *want, h, p, last = row
    for mode, value in zip(("popular", "winkler", "improve1", "improve2", "improve3"), want, strict=True):
        assert one(spark, jaro.jaro(F.col("a"), F.col("b"), mode, h, p, None), a=s1, b=s2) == pytest.approx(value, abs=1e-9), mode
    assert one(spark, jaro.jaro(F.col("a"), F.col("b"), "improve3_winkler", h, p, None), a=s1, b=s2) == pytest.approx(last, abs=1e-9)


def test_jaro_window_and_errors(spark):
    j = lambda a, b, w: one(spark, jaro.jaro(F.col("a"), F.col("b"), "popular", min_window=w), a=a, b=b)
    assert j("a", "a", None) == 0 and j("a", "a", 1.0) == 1
    assert j("ab", "ba", None) == 0 and j("ab", "ba", 1.0) == pytest.approx(5 / 6)
    assert j("", "a", 1.0) == 0
    for bad in ({"mode": "improve"}, {"h": 20, "p": 0.1}):
        with pytest.raises(ValueError):
            jaro.jaro(F.col("a"), F.col("b"), **bad)


def test_lcss_orders():
    a, b = list("abbca"), list("baca")
    assert {(tuple(q), tuple(x), tuple(y)) for q, x, y in (lcss.table_path(a, b), (lambda r: (r[0], r[2], r[1]))(lcss.table_path(b, a)))} == {(tuple("aca"), (0, 3, 4), (1, 2, 3)), (tuple("bca"), (2, 3, 4), (0, 2, 3))}
    assert lcss.unique(a, b, True, "any") == (list("bca"), [2, 3, 4], [0, 2, 3])
    assert lcss.unique(a, b, True, "both") == (list("ca"), [3, 4], [2, 3])
    assert lcss.unique(list("cdd"), list("cdabcba")) == ([], [], [])


ADDRESSES = [
    ("米庙镇尚庄乡农村淘宝昌源202西柚", "米庙镇尚庄乡农村淘宝早餐店102葡萄", "米庙镇尚庄乡农村淘宝", 0.729167),
    ("矿务局十字路口东豫华鞋城", "矿务局豫华鞋城", "矿务局豫华鞋城", 1.0),
    ("川沙镇和平南路和平村陈家宅8号", "川沙新镇和平南路陈家宅8号", "川沙镇和平南路陈家宅8号", 0.879121),
    ("徐丰公路东50米庞庄幼儿园(工人路)", "徐丰公路(昕南社区卫生服务站西南)庞庄支点双语工幼儿园(工人路)", "徐丰公路庞庄幼儿园工人路", 0.75),
    ("大理大学荷花校区", "大理大学下关校区", "大理大学校区", 0.805556),
    ("下关关平路86号", "下关关平路下段迎运来超市", "下关关平路", 0.744048),
    ("海东镇上河村蔚文街北附育英实验学校", "海东镇向阳街", "海东镇", 0.238095),
]


def test_lcss_similarity(spark):
    rows = spark.createDataFrame(ADDRESSES, "a string, b string, want string, sim double").select("want", "sim", text.tokens(F.col("a")).alias("a"), text.tokens(F.col("b")).alias("b"))
    got = rows.withColumn("r", lcss.unique_path(F.col("a"), F.col("b"))).select("want", "sim", F.array_join("r.que", "").alias("que"), lcss.distance(F.size("a"), F.size("b"), F.col("r.loc1"), F.col("r.loc2")).alias("d"), lcss.length(F.col("a"), F.col("b")).alias("n"), F.size("r.que").alias("k"))
    for r in got.collect():
        assert r["que"] == r["want"] and r["d"] == pytest.approx(r["sim"], abs=1e-6) and r["n"] >= r["k"]


def test_lcss_peeled():
    p = lambda a, b: lcss.peeled(list(a), list(b))
    assert p("abca", "baca") == [("aca", [0, 2, 3], [1, 2, 3]), ("bca", [1, 2, 3], [0, 2, 3])]
    assert p("degag", "gwgdfad") == [("da", [0, 3], [3, 5]), ("ga", [2, 3], [0, 5]), ("ga", [2, 3], [2, 5])]
    assert [t for t, _, _ in p("abchigdef", "defhigabc")] == ["abc", "hig", "def"]
    assert p("ab", "cd") == []


def test_lcss_properties():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 8))] for _ in range(2))
        n = len(lcss.table_path(a, b)[0])
        assert n == len(lcss.table_path(b, a)[0]) == max((len(t) for t, _, _ in lcss.peeled(a, b)), default=0)


def tagged(s):
    return [tuple(x.split("/")) for x in s.split()]


def test_sticky(spark):
    def run(s, column):
        df = spark.createDataFrame([(tagged(s),)], "pairs array<struct<word:string,flag:string>>")
        return [tuple(t) for t in df.select(column.alias("r")).collect()[0]["r"]]

    m = lambda s: run(s, sticky.merged(F.col("pairs"), sticky.PIPELINE))
    assert m("很/d 不/d 满意/v") == tagged("很/d 不满意/dv")
    assert m("不/d 满意/v") == tagged("不/d 满意/v")
    assert m("补/v 水/n 面膜/n") == tagged("补水/vn 面膜/n")
    assert run("面膜/x 补/v 水分/n", sticky.sticky(F.col("pairs"))) == tagged("补水分/vn")
    assert m("") == []


def test_relevance_all(spark):
    docs = spark.createDataFrame([(1, "不用 担心 简约 时尚 拿着 质量".split())], "doc int, tokens array<string>")
    got = {r["target_word"]: r["each"] for r in relevance.all_pairs(docs).where("flag_word = '不用'").collect()}
    assert [got[w] for w in "不用 担心 简约 时尚 拿着 质量".split()] == pytest.approx([1.048554, 1, 0.5, 0.19245, 0.0625, 0.017889], abs=1e-5)


def test_relevance_near(spark):
    pairs = [dict(zip(("word", "flag"), t, strict=True)) for t in tagged("物流/n 不满意/dv 物流/n 太慢/da 拿着/vu 质量/n")]
    docs = spark.createDataFrame([(1, pairs)], "doc int, pairs array<struct<word:string,flag:string>>")
    targets = spark.createDataFrame([("不满意",), ("太慢",)], "word string")
    got = {(r["flag_word"], r["target_word"]): r["each"] for r in relevance.near_pairs(docs, targets).collect()}
    assert got == pytest.approx({("物流", "不满意"): 1, ("物流", "太慢"): 1, ("质量", "不满意"): 1 / 3, ("质量", "太慢"): 1})


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([(0, ["ab", "ab", "cd"]), (1, ["cd", "ef", "ef"]), (2, ["ab", "ef", "gh"])], "doc int, tokens array<string>")
    w = tfidf.weights(tfidf.term_counts(docs), 0)
    got = {(r["term"], r["doc"]): r["w"] for r in w.collect()}
    assert got == pytest.approx({("ab", 0): 1, ("ab", 2): 0.36907, ("cd", 0): 1, ("cd", 1): 1, ("ef", 1): 1, ("ef", 2): 0.36907, ("gh", 2): 1}, abs=1e-5)
    sims = {(r["target_word"], r["sim_word"]): r["similarity"] for r in similarity.sparse_pairs(w).collect()}
    assert sims["ab", "cd"] == pytest.approx(0.831684, abs=1e-6) and sims["ef", "ab"] == pytest.approx(0.559942, abs=1e-6) and ("cd", "gh") not in sims and sims["gh", "gh"] == pytest.approx(1)


def grow(spark, pairs):
    rows = [(a, b) for p in pairs.split() for a, b in (p, p[::-1])]
    return {r["seed"]: "".join(r["members"]) for r in clusters.expand(spark.createDataFrame(rows, "target_word string, sim_word string")).collect()}


def test_clusters(spark):
    assert grow(spark, "ab bc cd de ef")["a"] == "ab"
    assert grow(spark, "ab ac ad be ce")["a"] == "abcde"
    assert grow(spark, "ab bc bd be")["a"] == "a"


def test_cover_and_votes(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("d", "e")], "target_word string, sim_word string")
    rows = spark.createDataFrame([("a", ["a", "b"]), ("b", ["a", "b"]), ("c", ["c"]), ("d", [])], "seed string, members array<string>")
    got = clusters.cover(rows, edges, spark.createDataFrame([("a", 1.0)], "word string, tf_min double"))
    assert sorted((r[0], r[1]) for r in got.collect()) == [("a", ["a", "b"]), ("c", ["c"])]
    v = synonyms.vote(spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (2, 0)], "k int, v int"), "k", "v")
    assert sorted(tuple(r) for r in v.collect()) == [(1, 1), (2, 0)]


def test_segment_and_edges_of_nulls(spark):
    assert longest("abcab", {"ab", "abc"}, 3) == ["abc", "ab"]
    empty = spark.createDataFrame([], "doc int, tokens array<string>")
    assert tfidf.weights(tfidf.term_counts(empty), 0).count() == 0
    assert math.isclose(1 / 3**1.5, 0.19245009, abs_tol=1e-8)


def test_sources_and_stream(spark, tmp_path):
    from textloom.sources import products
    from textloom.streaming import relevance as live

    (tmp_path / "l.tsv").write_text("a\tb\t1\n")
    assert tuple(products.labels(spark, str(tmp_path / "l.tsv")).collect()[0]) == ("a", "b", 1)
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "z"])], "doc int, tokens array<string>")
    docs.write.parquet(str(tmp_path / "in"))
    live.accumulate(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r[0], r[1]): r["total_num"] for r in live.totals(spark, str(tmp_path / "out")).collect()}
    assert got["x", "x"] == 2 and got["x", "y"] == 1
