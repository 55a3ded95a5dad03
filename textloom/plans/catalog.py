"""The queries of the library's own operators over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import jaro, lcss, text
from textloom.operators import clusters, relevance, richness, sequences, similarity, sticky, synonyms, tfidf
from textloom.plans import words
from textloom.session import folder
from textloom.sources import products

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: text.rounded(F.col(n), digits) for n in names})


def low_tokens(df: DataFrame, pattern: str = text.LETTERS) -> Column:
    return text.tokens(F.lower(df["text"]), pattern)


# ---- text -----------------------------------------------------------------------------------------------------------

TOKENS_SQL = r"regexp_extract_all(lower(text), '[0-9]+|\p{L}+')"


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+|[a-zA-Z]+|[一-龥]'), ' ') AS tokens FROM documents")
def t1_tokenize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id, replace(replace(replace(replace(replace('不太' || text || '为什么不是', '为什么', ''), '什么', ''), '怎么', ''), '不太', '不'), '不是', '不') AS cleaned FROM documents")
def t2_cleanup(spark, d):
    return read(spark, d, "documents").select("doc_id", text.cleaned(F.concat(F.lit("不太"), "text", F.lit("为什么不是"))).alias("cleaned"))


def flagged(toks: Column) -> Column:
    """Tokens with a made-up flag: x for marks, m for digits, else by length."""
    names = F.array(*(F.lit(x) for x in ("n", "v", "a", "d", "vn", "r")))
    flag = lambda w: F.when(w.rlike(r"^[0-9]"), "m").when(w.rlike(r"^\p{L}"), F.get(names, F.length(w) % 6)).otherwise("x")
    return F.transform(toks, lambda w: F.struct(w.alias("word"), flag(w).alias("flag")))


FLAG_SQL = r"CASE WHEN regexp_matches(w, '^[0-9]') THEN 'm' WHEN regexp_matches(w, '^\p{L}') THEN (['n','v','a','d','vn','r'])[length(w) % 6 + 1] ELSE 'x' END"


@query(rf"SELECT doc_id, array_to_string([w || '/' || {FLAG_SQL} FOR w IN regexp_extract_all(lower(text), '[0-9]+|\p{{L}}+|[^\s0-9\p{{L}}]') IF {FLAG_SQL} <> 'x'], ' ') AS kept FROM documents")
def t6_drop_marks(spark, d):
    df = read(spark, d, "documents")
    kept = text.kept_flags(flagged(low_tokens(df, text.MARKS)))
    return df.select("doc_id", F.array_join(F.transform(kept, lambda t: F.concat(t["word"], F.lit("/"), t["flag"])), " ").alias("kept"))


def _sticky(spark, d, rules):
    df = read(spark, d, "conversations")
    df = df.select("conv_id", "turn", flagged(low_tokens(df, text.MARKS)).alias("pairs"))
    out = sticky.sticky(F.col("pairs"), rules)
    return df.select("conv_id", "turn", F.array_join(F.transform(out, lambda t: F.concat(t["word"], F.lit("/"), t["flag"])), " ").alias("words"))


def _sticky_sql(rules: sticky.Rules) -> str:
    """The fold as a list reduction over tokens with their neighbours."""
    loose = lambda f: "CASE " + " ".join(f"WHEN {f} = '{k}' THEN {v}" for k, v in sticky.LOOSE.items()) + " ELSE 1.0 END"
    tight = lambda f: f"CASE WHEN ({loose(f)}) IN (0.0, 1.0) THEN ({loose(f)}) ELSE 10.0 - ({loose(f)}) END"
    end = f"{{'w': '{sticky.END[0]}', 'f': '{sticky.END[1]}'}}"
    negates = "t.h.w IN ('" + "', '".join(sticky.NEGATIONS) + "')"
    keep = f"length(x.w) > {rules.longer} AND regexp_matches(x.f, '[{rules.wanted}]') AND x.f <> '{rules.unwanted}'" if rules.wanted else "regexp_matches(x.f, '[^x]')"
    goes_back = "s.last IS NOT NULL AND t.stray AND t.back * s.damp >= t.ahead AND t.back * s.damp > 0"
    goes_ahead = "s.last IS NOT NULL AND ((t.stray AND t.back * s.damp < t.ahead AND t.ahead > 0) OR t.neg)"
    replaces, takes = f"({goes_back} AND t.b.f <> t.h.f)", f"({goes_ahead} AND (t.neg OR t.h.f <> t.n.f))"
    return rf"""
WITH toks AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[0-9]+|\p{{L}}+|[^\s0-9\p{{L}}]') AS a FROM conversations),
p AS (SELECT conv_id, turn, [{{'w': w, 'f': {FLAG_SQL}}} FOR w IN a] AS p FROM toks),
z AS (SELECT conv_id, turn, [{{'h': p[i], 'b': CASE WHEN i > 1 THEN p[i - 1] ELSE {end} END, 'n': CASE WHEN i < len(p) THEN p[i + 1] ELSE {end} END}} FOR i IN range(1, len(p) + 1)] AS z FROM p),
y AS (SELECT conv_id, turn, [{{'h': t.h, 'b': t.b, 'n': t.n, 'neg': {negates} AND t.n.f <> 'x', 'stray': length(t.h.w) = 1 AND NOT {negates} AND NOT contains('{rules.stop}', t.h.w) AND NOT contains('{sticky.FREE}', t.h.f),
  'back': power({loose("t.b.f")}, 2) * ({tight("t.h.f")}) / ceil(length(t.b.w) / 2), 'ahead': power({loose("t.h.f")}, 2) * ({tight("t.n.f")}) / ceil(length(t.n.w) / 2)}} FOR t IN z] AS y FROM z),
r AS (SELECT conv_id, turn, list_reduce(y, lambda s, t: CASE WHEN s.skip > 0 THEN {{'skip': s.skip - 1, 'damp': s.damp, 'done': s.done, 'last': s.last}} ELSE {{
  'skip': CASE WHEN {takes} AND length(t.n.w) > 1 THEN 1 ELSE 0 END, 'damp': CASE WHEN {goes_ahead} THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END,
  'done': CASE WHEN s.last IS NULL OR {replaces} THEN s.done ELSE list_append(s.done, s.last) END,
  'last': CASE WHEN {replaces} THEN {{'w': t.b.w || t.h.w, 'f': t.b.f || t.h.f}} WHEN {takes} THEN {{'w': t.h.w || t.n.w, 'f': t.h.f || t.n.f}} ELSE t.h END}} END,
  {{'skip': 0, 'damp': 1.0::DOUBLE, 'done': []::STRUCT(w VARCHAR, f VARCHAR)[], 'last': NULL::STRUCT(w VARCHAR, f VARCHAR)}}) AS r FROM y)
SELECT conv_id, turn, coalesce(array_to_string([x.w || '/' || x.f FOR x IN list_append(r.done, r.last) IF {keep}], ' '), '') AS words FROM r"""


@query(_sticky_sql(sticky.WORDS))
def t4_sticky_words(spark, d):
    return _sticky(spark, d, sticky.WORDS)


@query(_sticky_sql(sticky.PIPELINE))
def t5_sticky_pipeline(spark, d):
    return _sticky(spark, d, sticky.PIPELINE)


@query()
def t3_segment(spark, d):
    """Longest match against the benchmark's words joined without spaces."""
    words = read(spark, d, "benchmark").select(F.explode(text.tokens(F.lower("text"), text.LETTERS)).alias("w")).distinct()
    df = read(spark, d, "benchmark")
    from textloom.functions.segment import segment

    return segment(df.select("item_id", F.regexp_replace(F.lower("text"), r"\s+", "").alias("text")), words, "w").select("item_id", F.array_join("words", " ").alias("words"))


# ---- strings --------------------------------------------------------------------------------------------------------

_ALPHA = "(m - t) / m"
_W = "(ln(l1 + 1) / (ln(l1 + 1) + ln(l2 + 1)) * m / l1 + ln(l2 + 1) / (ln(l1 + 1) + ln(l2 + 1)) * m / l2)"


@query(
    f"""
WITH p AS (SELECT a.p_partkey AS k, a.p_name AS s1, b.p_name AS s2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
c AS (SELECT k, s1, s2, length(s1) AS l1, length(s2) AS l2, greatest(greatest(length(s1), length(s2)) / 2.0 - 1, 1) AS win FROM p),
f AS (SELECT *, list_reduce(range(1, l1 + 1), lambda acc, i: list_append(acc, coalesce(
        list_filter(range(1, l2 + 1), lambda j: s2[j:j] = s1[i:i] AND abs(j - i) <= win AND NOT list_contains(acc, j))[1], 0)), []::BIGINT[]) AS places FROM c),
g AS (SELECT *, list_filter(places, lambda j: j > 0) AS hit FROM f),
h AS (SELECT *, len(hit)::DOUBLE AS m, len(list_filter(range(1, len(hit) + 1), lambda i: s2[hit[i]:hit[i]] <> s2[list_sort(hit)[i]:list_sort(hit)[i]])) / 2.0 AS t,
        CASE WHEN s1[1:1] <> s2[1:1] THEN 0 WHEN s1[2:2] <> s2[2:2] THEN 1 WHEN s1[3:3] <> s2[3:3] THEN 2 ELSE 3 END AS pre FROM g),
v AS (SELECT k, pre, CASE WHEN m > 0 THEN (m / l1 + m / l2 + {_ALPHA}) / 3 ELSE 0 END AS a, CASE WHEN m > 0 THEN (m / l1 + m / l2) * 0.5 * {_ALPHA} ELSE 0 END AS b,
        CASE WHEN m > 0 THEN m / greatest(l1, l2) * {_ALPHA} ELSE 0 END AS c, CASE WHEN m > 0 THEN {_W} * {_ALPHA} ELSE 0 END AS d FROM h)
SELECT k AS p_partkey, round(a, 6) AS popular, round(a + pre * 0.1 * (1 - a), 6) AS winkler, round(b, 6) AS improve1, round(c, 6) AS improve2, round(d, 6) AS improve3,
  round(b + pre * 0.1 * (1 - b), 6) AS improve1_winkler, round(c + pre * 0.1 * (1 - c), 6) AS improve2_winkler, round(d + pre * 0.1 * (1 - d), 6) AS improve3_winkler FROM v"""
)
def s1_jaro(spark, d):
    part = read(spark, d, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("s1")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("s2")), "p_partkey")
    pairs = pairs.withColumn("m", jaro.matches(F.col("s1"), F.col("s2")))
    return pairs.select("p_partkey", *(text.rounded(jaro.jaro(F.col("s1"), F.col("s2"), mode, matched=F.col("m")), 6).alias(mode) for mode in jaro.MODES))


def _item_pairs(spark, d):
    df = read(spark, d, "benchmark").select("item_id", text.tokens(F.lower("text"), text.LETTERS).alias("a"))
    return df.join(df.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")


@query(
    f"""
WITH t AS (SELECT item_id, {TOKENS_SQL} AS a FROM benchmark), p AS (SELECT x.item_id, x.a, y.a AS b FROM t x JOIN t y ON y.item_id = x.item_id + 1),
rows AS (SELECT item_id, list_reduce(list_transform(a, lambda w: [w]), lambda prev, w: list_transform(list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [j])),
  lambda acc, j: list_append(acc, CASE WHEN b[j[1]] = w[1] THEN prev[j[1]]::BIGINT + 1 ELSE greatest(prev[j[1] + 1]::BIGINT, acc[j[1]]) END)), lambda x: x::VARCHAR),
  list_transform(range(0, len(b) + 1), lambda x: '0')) AS last FROM p)
SELECT item_id, last[-1]::INTEGER AS length FROM rows"""
)
def l1_length(spark, d):
    return _item_pairs(spark, d).select("item_id", lcss.length(F.col("a"), F.col("b")).alias("length"))


_ORDERS = f"""
RECURSIVE t AS (SELECT item_id, {TOKENS_SQL} AS a FROM benchmark),
p AS (SELECT x.item_id, 1 AS o, x.a, y.a AS b FROM t x JOIN t y ON y.item_id = x.item_id + 1 UNION ALL SELECT x.item_id, 2, y.a, x.a FROM t x JOIN t y ON y.item_id = x.item_id + 1),
tab AS (SELECT item_id, o, a, b, list_reduce(range(1, len(a) + 1), lambda acc, i: list_append(acc, list_reduce(range(1, len(b) + 1), lambda r, j: list_append(r, CASE WHEN b[j] = a[i] THEN acc[i][j] + 1 ELSE greatest(acc[i][j + 1], r[j]) END), [0::BIGINT])),
  [list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT)]) AS m FROM p),
way AS (SELECT item_id, o, len(a) AS i, len(b) AS j, false AS hit FROM tab UNION ALL
  SELECT w.item_id, w.o, CASE WHEN a[w.i] = b[w.j] OR m[w.i + 1][w.j] <= m[w.i][w.j + 1] THEN w.i - 1 ELSE w.i END, CASE WHEN a[w.i] = b[w.j] OR m[w.i + 1][w.j] > m[w.i][w.j + 1] THEN w.j - 1 ELSE w.j END, a[w.i] = b[w.j]
  FROM way w JOIN tab USING (item_id, o) WHERE m[w.i + 1][w.j + 1] > 0),
hits AS (SELECT item_id, o, a[i + 1] AS w, CASE o WHEN 1 THEN i ELSE j END AS x, CASE o WHEN 1 THEN j ELSE i END AS y FROM way JOIN tab USING (item_id, o) WHERE hit),
found AS (SELECT tab.item_id, tab.o, coalesce(list(w ORDER BY x) FILTER (w IS NOT NULL), []) AS que, coalesce(list(x ORDER BY x) FILTER (w IS NOT NULL), []) AS loc1, coalesce(list(y ORDER BY x) FILTER (w IS NOT NULL), []) AS loc2 FROM tab LEFT JOIN hits USING (item_id, o) GROUP BY ALL)"""


def _joined(r: str) -> list[Column]:
    return [F.array_join(f"{r}.que", " ").alias("que"), *(F.array_join(F.col(f"{r}.{x}").cast("array<string>"), ",").alias(x) for x in ("loc1", "loc2"))]


_SHOWN = "array_to_string(que, ' ') AS que, array_to_string(loc1, ',') AS loc1, array_to_string(loc2, ',') AS loc2"


@query(f"WITH {_ORDERS} SELECT item_id, {_SHOWN} FROM found WHERE o = 1")
def l1_path(spark, d):
    return _item_pairs(spark, d).select("item_id", lcss.path(F.col("a"), F.col("b")).alias("r")).select("item_id", *_joined("r"))


_GAP = "greatest(loc1[{0} + 1] - loc1[{0}], loc2[{0} + 1] - loc2[{0}]) = 1"
_KEPT = f"list_filter(range(1, len(que) + 1), lambda k: (k > 1 AND {_GAP.format('(k - 1)')}) OR (k < len(que) AND {_GAP.format('k')}))"


@query(
    f"""WITH {_ORDERS}, kept AS (SELECT *, {_KEPT} AS k FROM found),
near AS (SELECT item_id, o, list_transform(k, lambda i: que[i]) AS que, list_transform(k, lambda i: loc1[i]) AS loc1, list_transform(k, lambda i: loc2[i]) AS loc2 FROM kept),
gaps AS (SELECT *, CASE WHEN len(que) > 1 THEN (loc1[-1] - loc1[1] + loc2[-1] - loc2[1]) / (2.0 * (len(que) - 1)) END AS gap FROM near),
best AS (SELECT CASE WHEN x.que = y.que OR coalesce(x.gap <= y.gap, false) THEN x ELSE y END AS r FROM gaps x JOIN gaps y ON x.item_id = y.item_id AND x.o = 1 AND y.o = 2),
flat AS (SELECT r.item_id AS item_id, r.que AS que, r.loc1 AS loc1, r.loc2 AS loc2, len(p.a) AS n1, len(p.b) AS n2, len(r.que) AS n FROM best JOIN p ON p.item_id = r.item_id AND p.o = 1),
sums AS (SELECT *, ceil(least(n1, n2) * 0.75) AS need, ceil(greatest(n1, n2) * 0.5) AS half, list_sum(list_transform(loc1, lambda v: (n1 - v)::DOUBLE)) / (n1 * (n1 + 1) / 2.0) AS s1, list_sum(list_transform(loc2, lambda v: (n2 - v)::DOUBLE)) / (n2 * (n2 + 1) / 2.0) AS s2 FROM flat)
SELECT item_id, {_SHOWN}, round(CASE WHEN n = 0 THEN 0 ELSE greatest(s1, s2) * CASE WHEN n >= need AND (n >= half OR n >= 10) THEN 1 ELSE n / greatest(need, half) END END, 6) AS similarity FROM sums"""
)
def l4_unique(spark, d):
    rows = _item_pairs(spark, d).select("item_id", F.size("a").alias("n1"), F.size("b").alias("n2"), lcss.unique_path(F.col("a"), F.col("b")).alias("r"))
    return rows.select("item_id", *_joined("r"), text.rounded(lcss.distance(F.col("n1"), F.col("n2"), F.col("r.loc1"), F.col("r.loc2")), 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE t AS (SELECT item_id, {TOKENS_SQL} AS a FROM benchmark), p AS (SELECT x.item_id, x.a, y.a AS b FROM t x JOIN t y ON y.item_id = x.item_id + 1),
tab AS (SELECT item_id, a, b, list_reduce(range(1, len(a) + 1), lambda acc, i: list_append(acc, list_reduce(range(1, len(b) + 1), lambda r, j: list_append(r, CASE WHEN b[len(b) + 1 - j] = a[len(a) + 1 - i] THEN acc[i][j] + 1 ELSE greatest(acc[i][j + 1], r[j]) END), [0::BIGINT])),
  [list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT)]) AS m FROM p),
x AS (SELECT item_id, a, b, m, unnest(range(1, len(a) + 1)) AS i FROM tab), xy AS (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM x),
cell AS (SELECT item_id, i - 1 AS i, j - 1 AS j, a[i] AS w, 1 + m[len(a) - i + 1][len(b) - j + 1] AS depth FROM xy WHERE a[i] = b[j]),
nxt AS (SELECT c.item_id, c.i, c.j, min(n.i * 100000 + n.j) AS go FROM cell c JOIN cell n ON n.item_id = c.item_id AND n.depth = c.depth - 1 AND n.i > c.i AND n.j > c.j GROUP BY ALL),
way AS (SELECT item_id, i AS root_i, j AS root_j, i, j, w, depth FROM cell WHERE depth = (SELECT max(depth) FROM cell c WHERE c.item_id = cell.item_id) UNION ALL
  SELECT w.item_id, w.root_i, w.root_j, c.i, c.j, c.w, c.depth FROM way w JOIN nxt USING (item_id, i, j) JOIN cell c ON c.item_id = w.item_id AND c.i = go // 100000 AND c.j = go % 100000)
SELECT item_id, string_agg(w, '' ORDER BY i) AS text, string_agg(i::VARCHAR, ',' ORDER BY i) AS loc1, string_agg(j::VARCHAR, ',' ORDER BY i) AS loc2 FROM way GROUP BY item_id, root_i, root_j"""
)
def l8_peeled(spark, d):
    rows = _item_pairs(spark, d).select("item_id", F.explode(lcss.peeled_paths(F.col("a"), F.col("b"))).alias("r"))
    return rows.select("item_id", "r.text", *(F.array_join(F.col(f"r.{x}").cast("array<string>"), ",").alias(x) for x in ("loc1", "loc2")))


def _points(spark, d):
    """Two rising lists of places of equal length for every part."""
    k = F.col("p_partkey")
    one = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda i: (k * (i + 3)) % 7 < 4)
    two = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda i: (k * (i + 5)) % 11 < 6)
    rows = read(spark, d, "part").select("p_partkey", one.alias("x"), two.alias("y")).withColumn("n", F.least(F.size("x"), F.size("y")))
    return rows.select("p_partkey", F.slice("x", 1, "n").alias("loc1"), F.slice("y", 1, "n").alias("loc2"))


_POINTS = """
x AS (SELECT p_partkey, list_filter(range(0, 41), lambda i: (p_partkey * (i + 3)) % 7 < 4) AS x, list_filter(range(0, 41), lambda i: (p_partkey * (i + 5)) % 11 < 6) AS y FROM part),
p AS (SELECT p_partkey, x[1:least(len(x), len(y))] AS loc1, y[1:least(len(x), len(y))] AS loc2 FROM x)"""


def _keep_sql(mode: str) -> str:
    gap = lambda k: f"{'greatest' if mode == 'both' else 'least'}(loc1[{k} + 1] - loc1[{k}], loc2[{k} + 1] - loc2[{k}])"
    return f"array_to_string(list_filter(range(0, len(loc1)), lambda k: (k > 0 AND {gap('k')} = 1) OR (k < len(loc1) - 1 AND {gap('(k + 1)')} = 1)), ',')"


@query(
    f"""WITH {_POINTS}, m AS (SELECT *, CASE WHEN len(loc1) > 1 THEN (loc1[-1] - loc1[1] + loc2[-1] - loc2[1]) / (2.0 * (len(loc1) - 1)) END AS m1,
  CASE WHEN len(loc1) > 3 THEN (loc1[-2] - loc1[2] + loc2[-2] - loc2[2]) / (2.0 * (len(loc1) - 3)) END AS m2 FROM p)
SELECT p_partkey, {_keep_sql("both")} AS both_kept, {_keep_sql("any")} AS any_kept, round(m1, 6) AS gap1, coalesce(m1 <= m2, false) AS first_wins FROM m"""
)
def l2_l3_points(spark, d):
    rows = _points(spark, d)
    a, b = F.col("loc1"), F.col("loc2")
    inner = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))
    m1, m2 = lcss.gap_mean(a, b), lcss.gap_mean(inner(a), inner(b))
    return rows.select("p_partkey", F.array_join(lcss.keep_points(a, b, "both"), ",").alias("both_kept"), F.array_join(lcss.keep_points(a, b, "any"), ",").alias("any_kept"), text.rounded(m1, 6).alias("gap1"), lcss.first_wins(m1, m2).alias("first_wins"))


@query(
    f"""WITH {_POINTS}, s AS (SELECT p_partkey, len(loc1) AS n, ceil(0.75 * 41) AS a, ceil(0.5 * 45) AS b,
  list_sum(list_transform(loc1, lambda v: 41.0 - v)) / (41 * 42 / 2.0) AS s1, list_sum(list_transform(loc2, lambda v: 45.0 - v)) / (45 * 46 / 2.0) AS s2 FROM p)
SELECT p_partkey, round(CASE WHEN n = 0 THEN 0 ELSE greatest(s1, s2) * CASE WHEN n >= a AND (n >= b OR n >= 10) THEN 1 ELSE n / greatest(a, b) END END, 6) AS similarity FROM s"""
)
def l5_distance(spark, d):
    return _points(spark, d).select("p_partkey", text.rounded(lcss.distance(F.lit(41), F.lit(45), F.col("loc1"), F.col("loc2")), 6).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, ceil(l_extendedprice * l_discount * 100.0) / 100.0 AS up FROM lineitem")
def l6_roundup(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.roundup(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("up"))


@query(
    """WITH w AS (SELECT n, k, sum((n - k)::DOUBLE) OVER (PARTITION BY n ORDER BY k) / (n * (n + 1) / 2.0) AS share FROM range(1, 41) a(n), range(0, 40) b(k) WHERE k < n)
SELECT n, min(k) + 1 AS prefix, round((min(k) + 1) / n, 6) AS rate FROM w WHERE share >= 0.9 - 1e-12 GROUP BY n"""
)
def l7_thresholds(spark, d):
    """For each length the shortest prefix with 0.9 of the head weight."""
    rows = spark.range(1, 41).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("k"))
    share = F.sum((F.col("n") - F.col("k")).cast("double")).over(Window.partitionBy("n").orderBy("k")) / (F.col("n") * (F.col("n") + 1) / 2.0)
    got = rows.withColumn("share", share).where(F.col("share") >= 0.9 - 1e-12).groupBy("n").agg((F.min("k") + 1).alias("prefix"))
    return got.select("n", "prefix", text.rounded(F.col("prefix") / F.col("n"), 6).alias("rate"))


# ---- relevance ------------------------------------------------------------------------------------------------------

_V1_SIDE = "CASE flag WHEN 'n' THEN 1.0 WHEN 'vn' THEN 0.67 ELSE 0 END"


def _turns(df: DataFrame) -> Column:
    return F.concat_ws("-", df["conv_id"].cast("string"), df["turn"].cast("string"))


_TURNS = rf"""
toks AS (SELECT conv_id || '-' || turn AS doc, {TOKENS_SQL} AS a FROM conversations), rows AS (SELECT doc, unnest(a) AS w, unnest(range(0, len(a))) AS pos FROM toks),
hits AS (SELECT w, round(avg(length(w)) / 10, 2) AS coef FROM (SELECT unnest({TOKENS_SQL}) AS w FROM benchmark) WHERE length(w) > 4 GROUP BY w),
k AS (SELECT doc, w, {FLAG_SQL} AS flag, {_V1_SIDE.replace("flag", "(" + FLAG_SQL + ")")} AS side, w IN (SELECT w FROM hits) AS hit, pos FROM rows)"""


def _targets(spark, d):
    b = read(spark, d, "benchmark")
    return b.select(F.explode(low_tokens(b)).alias("word")).where(F.length("word") > 4).groupBy("word").agg(F.round(F.avg(F.length("word")) / 10, 2).alias("coef"))


def _turn_pairs(spark, d):
    df = read(spark, d, "conversations")
    return df.select(_turns(df).alias("doc"), flagged(low_tokens(df)).alias("pairs"))


_SUMS = "round(s, 6) AS sum_relevance, n AS total_num, round(s / n, 6) AS avg_relevance, round(s * s / n, 6) AS final_coef, rank() OVER (PARTITION BY flag_word ORDER BY round(s * s / n, 9) DESC) AS rank_in_flag_word"


@query(
    f"""WITH {_TURNS}, i AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM k WHERE hit OR side > 0),
e AS (SELECT a.doc, a.w AS flag_word, b.w AS target_word, max(a.side / CASE WHEN a.i = b.i THEN 0.9 ELSE abs(a.i - b.i) END) AS r FROM i a JOIN i b ON a.doc = b.doc AND a.side > 0 AND b.hit GROUP BY ALL),
s AS (SELECT flag_word, target_word, sum(r) AS s, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT flag_word, target_word, {_SUMS} FROM s) SELECT z.*, coef FROM z JOIN hits ON w = target_word"""
)
def r2_relevance_words(spark, d):
    got = relevance.summary(relevance.near_pairs(_turn_pairs(spark, d), _targets(spark, d)), _targets(spark, d))
    return rounded(got, "sum_relevance", "avg_relevance", "final_coef")


_FLAGGED = """
e AS (SELECT a.doc, a.w AS flag_word, b.w AS target_word, max({side} / power(CASE WHEN a.pos = b.pos THEN 0.9 ELSE abs(a.pos - b.pos) END, CASE WHEN a.pos = b.pos THEN 0.9 ELSE abs(a.pos - b.pos) END / 2.0)) AS r,
  arg_min(a.flag, a.pos) AS ff, arg_min(b.flag, b.pos) AS tf FROM k a JOIN k b ON a.doc = b.doc{where} GROUP BY ALL),
s AS (SELECT flag_word, target_word, sum(r) AS s, count(*) AS n, arg_min(ff, doc) AS flag_flag, arg_min(tf, doc) AS target_flag FROM e GROUP BY ALL)"""


@query(f"""WITH {_TURNS}, {_FLAGGED.format(side="a.side", where=" AND a.side > 0 AND b.hit")}, z AS (SELECT flag_word, target_word, flag_flag, target_flag, {_SUMS} FROM s) SELECT z.*, coef FROM z JOIN hits ON w = target_word""")
def r3_relevance_targets(spark, d):
    """Words with a weighted flag against target words by original positions, with both flags and the target's coefficient."""
    got = relevance.summary(relevance.flagged_pairs(_turn_pairs(spark, d), _targets(spark, d)), _targets(spark, d))
    return rounded(got, "sum_relevance", "avg_relevance", "final_coef")


_ITEMS = rf"""
toks AS (SELECT item_id AS doc, {TOKENS_SQL} AS a FROM benchmark), rows AS (SELECT doc, unnest(a) AS w, unnest(range(0, len(a))) AS pos FROM toks), k AS (SELECT doc, w, {FLAG_SQL} AS flag, pos FROM rows)"""


@query(f"""WITH {_ITEMS}, {_FLAGGED.format(side="1", where="")} SELECT flag_word, target_word, flag_flag, target_flag, {_SUMS} FROM s""")
def r4_relevance_flags(spark, d):
    """Every word of an item against every other, with the flags of the first pair."""
    b = read(spark, d, "benchmark")
    got = relevance.summary(relevance.flagged_pairs(b.select(F.col("item_id").alias("doc"), flagged(low_tokens(b)).alias("pairs"))))
    return rounded(got, "sum_relevance", "avg_relevance", "final_coef")


_V2 = rf"""
toks AS (SELECT item_id AS doc, {TOKENS_SQL} AS a FROM benchmark), rows AS (SELECT doc, unnest(a) AS w, unnest(range(0, len(a))) AS pos FROM toks),
e AS (SELECT a.doc, a.w AS flag_word, b.w AS target_word, max(1 / power(CASE WHEN a.pos = b.pos THEN 0.9 ELSE abs(a.pos - b.pos) END, CASE WHEN a.pos = b.pos THEN 0.9 ELSE abs(a.pos - b.pos) END / 2.0)) AS r
  FROM rows a JOIN rows b ON a.doc = b.doc GROUP BY ALL),
s AS (SELECT flag_word, target_word, sum(r) AS s, count(*) AS n FROM e GROUP BY ALL)"""


def _benchmark_relevance(spark, d):
    b = read(spark, d, "benchmark")
    return relevance.summary(relevance.all_pairs(b.select(F.col("item_id").alias("doc"), low_tokens(b).alias("tokens"))))


@query(
    f"""WITH {_V2} SELECT flag_word, target_word, round(s, 6) AS sum_relevance, n AS total_num, round(s / n, 6) AS avg_relevance, round(s * s / n, 6) AS final_coef,
  rank() OVER (PARTITION BY flag_word ORDER BY round(s * s / n, 9) DESC) AS rank_in_flag_word FROM s"""
)
def r4_relevance_all(spark, d):
    return rounded(_benchmark_relevance(spark, d), "sum_relevance", "avg_relevance", "final_coef")


# ---- vectors --------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p) SELECT a, b, round(s, 6) AS similarity FROM r WHERE k <= 10 AND s >= 0.3"""
)
def v1_dense_top(spark, d):
    got = similarity.dense_top(read(spark, d, "embeddings").select("vec_id", "embedding"), 10)
    return rounded(got.where("similarity >= 0.3"), "similarity")


@query(
    """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p) SELECT a, b, round(0.5 * s + 0.5, 6) AS similarity FROM r WHERE k <= 6"""
)
def c4_dense_half(spark, d):
    """The older matrix form: scaled to 0..1, one row more than asked for."""
    got = similarity.dense_top(read(spark, d, "embeddings").select("vec_id", "embedding"), 5 + 1)
    return got.select("a", "b", text.rounded(F.col("similarity") * 0.5 + 0.5, 6).alias("similarity"))


@query()
def v1_word2vec(spark, d):
    """Vectors of the conversations' words, and each word's 10 nearest others of cosine 0.5 at least, filtered after the top 10."""
    df = read(spark, d, "conversations")
    return similarity.nearest_words(df.select(low_tokens(df).alias("tokens")))


def _source_counts(spark, d):
    df = read(spark, d, "documents")
    return tfidf.term_counts(df.select(F.col("source").alias("doc"), low_tokens(df).alias("tokens")))


_COUNTS = f"c AS (SELECT doc, term, count(*) AS n FROM (SELECT source AS doc, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY ALL)"
_ITEM_COUNTS = f"c AS (SELECT doc, term, count(*) AS n FROM (SELECT item_id AS doc, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY ALL)"


def _weights_sql(min_tf: str) -> str:
    return f"""
st AS (SELECT term, sum(n) AS tf, count(*) AS df FROM c GROUP BY term), docs AS (SELECT count(DISTINCT doc) AS docs FROM c),
raw AS (SELECT c.doc, c.term, st.tf, st.df, docs.docs, n / sum(n) OVER (PARTITION BY c.doc) * log2(docs.docs / st.df) AS x FROM c JOIN st USING (term), docs),
yy AS (SELECT *, x / nullif(max(x) OVER (PARTITION BY doc), 0) AS y FROM raw),
w AS (SELECT doc, term, CASE WHEN df < docs THEN y / nullif(max(y) OVER (PARTITION BY term), 0) END AS w FROM yy WHERE tf > {min_tf})"""


@query(f"WITH {_COUNTS} SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM c GROUP BY term HAVING sum(n) > 3")
def f1_term_stats(spark, d):
    return tfidf.term_stats(_source_counts(spark, d))


@query(f"WITH {_COUNTS}, {_weights_sql('3')} SELECT doc, term, round(w, 6) AS w FROM w")
def f2_weights(spark, d):
    return rounded(tfidf.weights(_source_counts(spark, d)), "w")


@query(f"WITH {_COUNTS}, {_weights_sql('3')} SELECT term, array_to_string(list(round(w, 5)::DECIMAL(9,5) ORDER BY doc), ',') AS vals, array_to_string(list(doc ORDER BY doc), ',') AS docs FROM w WHERE w <> 0 GROUP BY term")
def f6_vectors(spark, d):
    v = tfidf.vectors(tfidf.weights(_source_counts(spark, d)))
    return v.select("term", F.array_join(F.transform("values", lambda x: text.rounded(x, 5).cast("decimal(9,5)").cast("string")), ",").alias("vals"), F.array_join("docs", ",").alias("docs"))


@query(
    f"""WITH {_COUNTS}, s AS (SELECT term FROM c GROUP BY term HAVING sum(n) > 3)
SELECT term, row_number() OVER (ORDER BY term COLLATE C) AS rankx FROM s WHERE length(term) > 1 AND regexp_matches(term, '[一-龥a-zA-Z]')""".replace(" COLLATE C", "")
)
def f5_term_numbers(spark, d):
    return tfidf.numbered(tfidf.term_stats(_source_counts(spark, d)))


@query(
    f"""WITH t AS (SELECT DISTINCT item_id % 7 AS doc, {TOKENS_SQL} AS a FROM benchmark) SELECT doc, array_to_string(flatten(list(a ORDER BY a)), ' ') AS tokens FROM t GROUP BY doc"""
)
def e2_topic_corpus(spark, d):
    b = read(spark, d, "benchmark")
    got = tfidf.topic_corpus(b.select((F.col("item_id") % 7).alias("topic"), low_tokens(b).alias("t")), "topic", "t")
    return got.select("doc", F.array_join("tokens", " ").alias("tokens"))


def _pairs_sql(source: str, min_tf: str, decay: str) -> str:
    return f"""
WITH {source}, {_weights_sql(min_tf)}, v AS (SELECT * FROM w WHERE w <> 0), sz AS (SELECT term, sqrt(sum(w * w)) AS norm, count(*) AS nnz FROM v GROUP BY term),
dots AS (SELECT a.term AS a, b.term AS b, sum(a.w * b.w) AS dot, count(*) AS shared FROM v a JOIN v b ON a.doc = b.doc GROUP BY ALL),
sim AS (SELECT a AS target_word, b AS sim_word, (dot / (x.norm * y.norm) * 0.5 + 0.5) * {decay} AS similarity FROM dots JOIN sz x ON x.term = a JOIN sz y ON y.term = b)"""


_DECAY = "CASE WHEN least(shared / x.nnz, shared / y.nnz) < 0.5 THEN least(shared / x.nnz, shared / y.nnz) / 0.5 ELSE 1 END"


def _item_weights(spark, d):
    b = read(spark, d, "benchmark")
    return tfidf.weights(tfidf.term_counts(b.select(F.col("item_id").alias("doc"), low_tokens(b).alias("tokens"))), 0)


@query(_pairs_sql(_ITEM_COUNTS, "0", _DECAY) + " SELECT target_word, sim_word, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.55")
def c1_sparse_pairs(spark, d):
    return rounded(similarity.sparse_pairs(_item_weights(spark, d)).where("similarity >= 0.55"), "similarity")


@query(
    """WITH p AS (SELECT p_partkey, list_distinct(list_transform(range(0, 9), lambda i: (p_partkey * (i + 3)) % 17)) AS u, list_distinct(list_transform(range(0, 9), lambda i: (p_partkey * (i + 5)) % 19)) AS v FROM part),
q AS (SELECT p_partkey, list_sort(list_distinct(list_concat(u, v))) AS w, u, v FROM p), r AS (SELECT p_partkey, list_transform(w, lambda k: CASE WHEN list_contains(u, k) THEN k / 7.0 ELSE 0.25 END) AS x, list_transform(w, lambda k: CASE WHEN list_contains(v, k) THEN (k + 1) / 5.0 ELSE 0.25 END) AS y FROM q)
SELECT p_partkey, len(x) AS n, round(0.5 * list_dot_product(x::DOUBLE[], y::DOUBLE[]) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[]) * list_dot_product(y::DOUBLE[], y::DOUBLE[])) + 0.5, 6) AS similarity FROM r"""
)
def c2_aligned(spark, d):
    """Two sparse vectors of each part over the union of their places, filled with 0.25."""
    k = F.col("p_partkey")
    places = lambda a, m: F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (k * (i + a)) % m))
    rows = read(spark, d, "part").select("p_partkey", places(3, 17).alias("u"), places(5, 19).alias("v"))
    both = similarity.aligned(F.col("u"), F.transform("u", lambda x: x / 7.0), F.col("v"), F.transform("v", lambda x: (x + 1) / 5.0), 0.25)
    return rows.select("p_partkey", both.alias("p")).select("p_partkey", F.size("p").alias("n"), text.rounded(similarity.aligned_cosine(F.col("p")), 6).alias("similarity"))


@query(_pairs_sql(_ITEM_COUNTS, "0", "1") + " SELECT target_word, sim_word, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.55")
def c5_sparse_no_decay(spark, d):
    return rounded(similarity.sparse_pairs(_item_weights(spark, d), decay=False).where("similarity >= 0.55"), "similarity")


@query(
    f"""WITH {_COUNTS}, {_weights_sql("3")}, v AS (SELECT * FROM w WHERE w <> 0), ds AS (SELECT doc, row_number() OVER (ORDER BY doc) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT doc FROM v)),
l AS (SELECT term, max(m) AS m, sqrt(sum(w * w)) AS norm, count(*) AS nnz, map(list(k), list(w)) AS mp FROM v JOIN ds USING (doc) GROUP BY term),
x AS (SELECT term, nnz, [coalesce(mp[k], 0) / norm FOR k IN range(1, m + 1)]::DOUBLE[] AS u, [CASE WHEN mp[k] IS NULL THEN 0 ELSE 1 END FOR k IN range(1, m + 1)]::DOUBLE[] AS i FROM l),
p AS (SELECT a.term AS t, b.term AS s, list_dot_product(a.u, b.u) * 0.5 + 0.5 AS h, list_dot_product(a.i, b.i) / greatest(a.nnz, b.nnz) AS share FROM x a, x b WHERE list_dot_product(a.i, b.i) > 0),
q AS (SELECT t, s, h * CASE WHEN share < 0.5 THEN share / 0.5 ELSE 1 END AS y FROM p),
r AS (SELECT t, unnest(min({{'y': -round(y, 6), 's': s}}, 50)) AS z, unnest(range(1, 51)) AS rank FROM q WHERE y >= 0.55 GROUP BY t)
SELECT t AS target_word, z.s AS sim_word, -z.y AS similarity, rank FROM r WHERE z IS NOT NULL"""
)
def c3_sparse_topk(spark, d):
    """Flagship: terms of the documents' sources that occur more than three times, the 50 most similar terms of each."""
    return similarity.sparse_top(tfidf.weights(_source_counts(spark, d)), 50, 0.55)


# ---- unrichness, features, rules ------------------------------------------------------------------------------------


@query(
    f"WITH {_COUNTS} SELECT doc, sum(n)::BIGINT AS doc_tf, round(avg(n) / sum(n), 9) AS avg, round(stddev_pop(n) / sum(n), 9) AS std FROM c GROUP BY doc"
)
def u1_doc_ratios(spark, d):
    return rounded(richness.doc_ratios(_source_counts(spark, d))[1], "avg", "std", digits=9)


_UNRICH = f"""
{_ITEM_COUNTS}, ds AS (SELECT doc, sum(n) AS doc_tf, avg(n) / sum(n) AS avg, stddev_pop(n) / sum(n) AS std FROM c GROUP BY doc), {_V2},
strong AS (SELECT flag_word, target_word, n FROM s WHERE s / n > 1 / power(3.0, 1.5)), tot AS (SELECT flag_word, n FROM strong WHERE flag_word = target_word),
p AS (SELECT a.flag_word, a.target_word, a.n / tot.n AS p FROM strong a JOIN tot USING (flag_word) WHERE a.flag_word <> a.target_word),
f AS (SELECT p.flag_word, p.target_word, p.p, sum(ds.doc_tf * (b.n / ds.doc_tf)) / nullif(sum(ds.doc_tf * (ds.avg + 1.5 * ds.std)), 0) AS f
  FROM p JOIN c a ON a.term = p.flag_word JOIN c b ON b.term = p.target_word AND b.doc = a.doc JOIN ds ON ds.doc = a.doc GROUP BY ALL),
u AS (SELECT flag_word, sum(CASE WHEN f >= 1 THEN p ELSE 0 END) / sum(p) AS p_coef, log2(sum(CASE WHEN f >= 1 THEN p * f ELSE 0 END) + 2) AS pf_weight, avg(p) / 0.1 AS p_over_thr, 100.0 / count(*) AS context_num_coef FROM f GROUP BY flag_word)"""


def _item_counts(spark, d):
    b = read(spark, d, "benchmark")
    return tfidf.term_counts(b.select(F.col("item_id").alias("doc"), low_tokens(b).alias("tokens")))


def _unrichness(spark, d):
    tf_r, stats = richness.doc_ratios(_item_counts(spark, d))
    return richness.unrichness(richness.frequency_coef(richness.shared_ratio(_benchmark_relevance(spark, d)), tf_r, stats))


@query(f"WITH {_UNRICH} SELECT flag_word, round(p_coef, 6) AS p_coef, round(pf_weight, 6) AS pf_weight, round(p_over_thr, 6) AS p_over_thr, round(context_num_coef, 6) AS context_num_coef, round(p_coef * pf_weight, 6) AS unrichness_coef FROM u")
def u4_unrichness(spark, d):
    return rounded(_unrichness(spark, d), "p_coef", "pf_weight", "p_over_thr", "context_num_coef", "unrichness_coef")


def _features(spark, d):
    """Candidates from the benchmark's terms: the sparse cosine stands for both vectors, jaro for the strings."""
    pairs = similarity.sparse_pairs(_item_weights(spark, d)).where("similarity >= 0.55 and target_word < sim_word").withColumnRenamed("similarity", "tfidf")
    pairs = pairs.withColumn("w2v", F.col("tfidf")).withColumn("jaro", F.size(F.array_intersect(F.split("target_word", ""), F.split("sim_word", ""))) / F.greatest(F.length("target_word"), F.length("sim_word")))
    return synonyms.features(pairs, tfidf.term_stats(_item_counts(spark, d), 1), _benchmark_relevance(spark, d), _unrichness(spark, d), 0.55, 0.55, 1)


_CHARS = "list_intersect(string_split({0}, ''), string_split({1}, ''))"
_MAXMIN = ", ".join(f"greatest(a.{x}, b.{x}) AS {y}_max, least(a.{x}, b.{x}) AS {y}_min" for x, y in (("tf", "tf"), ("p_coef", "p_coef"), ("pf_weight", "pf_weight"), ("p_over_thr", "p_over_thr"), ("context_num_coef", "context_num"), ("ur", "unrich")))
_FEATURES = _pairs_sql(_ITEM_COUNTS, "0", _DECAY).replace(f"WITH {_ITEM_COUNTS},", f"WITH {_UNRICH},") + f""",
one AS (SELECT term, st.tf, st.df, u.*, u.p_coef * u.pf_weight AS ur FROM st JOIN u ON u.flag_word = st.term WHERE st.tf > 1),
cand AS (SELECT target_word, sim_word, similarity AS tfidf, similarity AS w2v, len(list_distinct({_CHARS.format("target_word", "sim_word")})) / greatest(length(target_word), length(sim_word)) AS jaro FROM sim WHERE similarity >= 0.55 AND target_word < sim_word),
rel AS (SELECT flag_word, target_word AS tw, s / n AS av, s * s / n AS fin FROM s),
feat AS (SELECT target_word, sim_word, w2v, jaro, tfidf, w2v + tfidf AS w2v_tfidf, jaro + tfidf AS jaro_tfidf, {_MAXMIN}, greatest(a.df, b.df) AS df_max, coalesce(av, 0) AS avg_relevance,
  CASE WHEN av > 0 THEN len(list_distinct({_CHARS.format("target_word", "sim_word")})) / greatest(length(target_word), length(sim_word)) ELSE 0 END AS flag_cond, CASE WHEN av > 0 THEN fin / (av * av) ELSE 0 END AS n,
  CASE WHEN av > 0 THEN fin / (av * av) / (least(a.tf, b.tf) / 5.0) ELSE 0 END AS co_occurrence_cond
  FROM cand JOIN one a ON a.term = target_word JOIN one b ON b.term = sim_word LEFT JOIN rel ON rel.flag_word = target_word AND rel.tw = sim_word)"""
_FEATURE_NAMES = ["w2v", "jaro", "tfidf", "w2v_tfidf", "jaro_tfidf", "p_coef_max", "p_coef_min", "pf_weight_max", "pf_weight_min", "p_over_thr_max", "p_over_thr_min", "context_num_max", "context_num_min", "unrich_max", "unrich_min", "avg_relevance", "flag_cond", "n", "co_occurrence_cond"]
_WHOLE = ["tf_max", "tf_min", "df_max"]


@query(_FEATURES + " SELECT target_word, sim_word, " + ", ".join(f"round({x}, 5) AS {x}" for x in _FEATURE_NAMES) + ", " + ", ".join(f"{x}::BIGINT AS {x}" for x in _WHOLE) + " FROM feat")
def g2_features(spark, d):
    return rounded(_features(spark, d), *_FEATURE_NAMES, digits=5)


_RULE = """
SELECT target_word, sim_word, CASE WHEN NOT vec THEN 0 WHEN keep AND tf_max >= r AND NOT (tf_min < r AND df_max <= 5) AND NOT poor THEN 1 ELSE 2 END AS rule_pred FROM (
SELECT *, (tfidf >= 0.7 AND (w2v_tfidf >= 1.5 OR jaro >= 0.8)) OR (tfidf < 0.7 AND jaro_tfidf >= 0.95) AS vec,
  co_occurrence_cond < 4 AND ((avg_relevance > 0 AND avg_relevance < 1 / power(3.0, 1.5)) OR (flag_cond <> 0 AND jaro > 0.3 AND flag_cond >= 0.5 AND (avg_relevance < 0.9 OR (co_occurrence_cond < 1 AND n < r)))) AS keep,
  p_coef_max > 0.6 OR p_over_thr_min > 1.2 OR (p_coef_max > 0.4 AND jaro >= 0.5 AND p_coef_max + p_over_thr_min > 0.85) OR (p_coef_max > 0.4 AND jaro < 0.5 AND p_coef_max + p_over_thr_min > 0.7) AS poor
FROM feat, (SELECT quantile_cont(tf_max, 0.95) / 5 * 0.1 AS r FROM feat))"""


@query(_FEATURES + _RULE)
def p2_rules(spark, d):
    return synonyms.apply_rule(_features(spark, d)).select("target_word", "sim_word", "rule_pred")


@query("SELECT doc_id, ntile(5) OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS fold FROM labels")
def p3_folds(spark, d):
    return synonyms.split_folds(read(spark, d, "labels").select("doc_id"), 5, "doc_id")


@query()
def p3_weighted_split(spark, d):
    parts = synonyms.split_weighted(read(spark, d, "labels").select("doc_id"), [0.7, 0.2])
    return parts[0].withColumn("part", F.lit(0)).unionByName(parts[1].withColumn("part", F.lit(1)))


@query(
    """WITH a AS (SELECT toxic AS v, avg((quality = toxic)::INT) AS p FROM labels GROUP BY toxic), b AS (SELECT quality AS v, avg((quality = toxic)::INT) AS r FROM labels GROUP BY quality)
SELECT coalesce(a.v, b.v) AS label, round(p, 9) AS precision, round(r, 9) AS recall FROM a FULL JOIN b ON a.v = b.v"""
)
def p4_precision_recall(spark, d):
    return rounded(synonyms.precision_recall(read(spark, d, "labels"), "quality", "toxic"), "precision", "recall", digits=9)


@query("WITH n AS (SELECT c_nationkey, c_custkey % 4 AS v, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, arg_max(v, n * 100 - v) AS vote FROM n GROUP BY c_nationkey")
def p5_vote(spark, d):
    return synonyms.vote(read(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 4).alias("v")), "c_nationkey", "v")


@query(
    """WITH r AS (SELECT c_nationkey, c_custkey % 4 AS v, 1.0 / (1 + c_custkey % 8) AS w FROM customer), n AS (SELECT c_nationkey, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT c_nationkey, v, round(sum(w), 9) AS s FROM r GROUP BY ALL),
b AS (SELECT c_nationkey, s, v FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY s DESC, v) = 1) SELECT c_nationkey, CASE WHEN s * n / nullif(2.0 * (n - 1), 0) >= 0.5 THEN v END AS vote FROM b JOIN n USING (c_nationkey)"""
)
def p5_weighted_vote(spark, d):
    rows = read(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 4).alias("v"), (1.0 / (1 + F.col("c_custkey") % 8)).alias("w"))
    return synonyms.weighted_vote(rows, "c_nationkey", "v", "w")


_PARTS = ["p_size", "p_retailprice", "name", "brand"]


def _labelled(spark, d):
    part = read(spark, d, "part")
    return part.select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("name"), (F.crc32("p_brand") % 7).alias("brand"), F.when(F.col("p_partkey") % 5 > 0, ((F.col("p_size") * 3 + F.length("p_name")) % 50 > 20).cast("int")).alias("is_sim"))


@query()
def p6_boosted(spark, d):
    return synonyms.boosted(_labelled(spark, d), _PARTS, "is_sim").select("p_partkey", "is_sim", "mdl_pred")


@query()
def p5_stacked(spark, d):
    return synonyms.stacked(_labelled(spark, d), _PARTS, "is_sim", "p_partkey").select("p_partkey", "is_sim", "kfold_pred")


# ---- clusters -------------------------------------------------------------------------------------------------------


def _word_edges(spark, d):
    return similarity.sparse_pairs(_item_weights(spark, d)).where("similarity >= 0.9 and target_word <> sim_word").select("target_word", "sim_word")


@query()
def e3_word_clusters(spark, d):
    """The whole chain over the conversations, topics by their number: features from trained vectors and Jaro, rules, clusters."""
    df = read(spark, d, "conversations")
    docs = df.select(_turns(df).alias("doc"), (F.col("conv_id") % 9).alias("topic"), low_tokens(df).alias("tokens"))
    return words.build(docs, f"{folder(spark)}/words", words.Settings(least_w2v=0.5, min_tf=3))


def _expand_sql(rounds: int = 7) -> str:
    """The rounds one after the other; cur{r} has the members, st{r} the state of the seeds that still grow."""
    parts = [
        _pairs_sql(_ITEM_COUNTS, "0", _DECAY),
        "e AS MATERIALIZED (SELECT DISTINCT target_word AS a, sim_word AS b FROM sim WHERE similarity >= 0.9 AND target_word <> sim_word)",
        "deg AS (SELECT a, count(*) AS n FROM e GROUP BY a)",
        "cur0 AS (SELECT a AS seed, a AS w FROM deg)",
        "st0 AS (SELECT a AS seed, 99 AS last, 0 AS depth, 0 AS eq FROM deg)",
    ]
    for r in range(rounds):
        parts += [
            f"found{r} AS MATERIALIZED (SELECT DISTINCT c.seed, e.b AS w FROM cur{r} c JOIN e ON e.a = c.w WHERE NOT EXISTS (SELECT 1 FROM cur{r} x WHERE x.seed = c.seed AND x.w = e.b))",
            f"n{r} AS (SELECT seed, count(*) AS conv FROM found{r} GROUP BY seed)",
            f"step{r} AS MATERIALIZED (SELECT *, live AND conv <= last AND eq2 < 2 AS grow FROM (SELECT seed, last, depth, coalesce(conv, 0) AS conv, eq + (coalesce(conv, 0) = last)::INT AS eq2, last > 0 AND depth <= 5 AND eq < 2 AS live FROM st{r} LEFT JOIN n{r} USING (seed)))",
            f"src{r} AS (SELECT DISTINCT c.seed, c.w FROM step{r} JOIN cur{r} c USING (seed) JOIN e ON e.a = c.w JOIN found{r} f ON f.seed = c.seed AND f.w = e.b WHERE NOT grow)",
            f"side{r} AS (SELECT DISTINCT c.seed, c.w FROM step{r} JOIN cur{r} c USING (seed) JOIN e ON e.a = c.w JOIN src{r} x ON x.seed = c.seed AND x.w = e.b WHERE NOT grow AND NOT EXISTS (SELECT 1 FROM src{r} y WHERE y.seed = c.seed AND y.w = c.w))",
            f"lone{r} AS (SELECT o.seed, o.w FROM (SELECT seed, min(w) AS w FROM side{r} GROUP BY seed HAVING count(*) = 1) o JOIN (SELECT seed, count(*) AS k FROM src{r} GROUP BY seed) k ON k.seed = o.seed JOIN deg ON deg.a = o.w WHERE k > 1 AND k > n - k)",
            f"end{r} AS (SELECT seed, list(w ORDER BY w) FILTER (WHERE NOT (live AND gone)) AS members FROM (SELECT s.seed, s.live, c.w, EXISTS (SELECT 1 FROM src{r} x WHERE x.seed = c.seed AND x.w = c.w) OR EXISTS (SELECT 1 FROM lone{r} y WHERE y.seed = c.seed AND y.w = c.w) AS gone FROM step{r} s JOIN cur{r} c USING (seed) WHERE NOT s.grow) GROUP BY seed)",
            f"cur{r + 1} AS MATERIALIZED (SELECT c.seed, c.w FROM cur{r} c JOIN step{r} USING (seed) WHERE grow UNION SELECT f.seed, f.w FROM found{r} f JOIN step{r} USING (seed) WHERE grow)",
            f"st{r + 1} AS (SELECT seed, conv AS last, depth + 1 AS depth, eq2 AS eq FROM step{r} WHERE grow)",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM end{r}" for r in range(rounds))
    return ", ".join(parts) + f", ended AS (SELECT seed, coalesce(members, []) AS members FROM ({every}))"


@query(_expand_sql() + " SELECT seed, array_to_string(members, ',') AS members, len(members) AS size FROM ended")
def k1_expand(spark, d):
    got = clusters.expand(_word_edges(spark, d))
    return got.select("seed", F.array_join("members", ",").alias("members"), "size")


@query(
    _expand_sql().replace("WITH ", "WITH RECURSIVE ", 1)
    + """, turns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC, coalesce(tf, 0) DESC, seed) AS i, seed, members FROM ended JOIN deg ON deg.a = seed LEFT JOIN st ON st.term = seed),
walk AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS seed, false AS fresh, []::VARCHAR[] AS covered UNION ALL
  SELECT t.i, t.seed, len(members) > 0 AND NOT list_contains(covered, t.seed), CASE WHEN len(members) > 0 AND NOT list_contains(covered, t.seed) THEN list_concat(covered, members) ELSE covered END FROM walk w JOIN turns t ON t.i = w.i + 1)
SELECT seed AS center_word, array_to_string(members, ',') AS members FROM walk JOIN turns USING (i, seed) WHERE fresh"""
)
def k2_cover(spark, d):
    edges = _word_edges(spark, d)
    stats = tfidf.term_stats(_item_counts(spark, d), 0).select(F.col("term").alias("word"), F.col("tf").alias("tf_min"))
    return clusters.cover(clusters.expand(edges), edges, stats).select("center_word", F.array_join("members", ",").alias("members"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey % 97 AS x, 'd' || o_orderkey % 89 AS y FROM orders),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS node, x AS c FROM b UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node"""
)
def k3_reachable(spark, d):
    o = read(spark, d, "orders")
    return clusters.reachable(o.select(F.concat(F.lit("c"), F.col("o_custkey") % 97).alias("x"), F.concat(F.lit("d"), F.col("o_orderkey") % 89).alias("y")), "x", "y")


# ---- sequences ------------------------------------------------------------------------------------------------------

_SEQS = f"""
RECURSIVE g AS (SELECT c_custkey AS k, 3 + c_custkey % 7 AS left_, (c_custkey % 10)::INT AS num, 0 AS last, '{sequences.ALPHABET}'[c_custkey % 26 + 1] AS c, []::VARCHAR[] AS x, []::VARCHAR[] AS y FROM customer
  UNION ALL SELECT k, left_ - 1, (last + num) % 10, num, '{sequences.ALPHABET}'[(instr('{sequences.ALPHABET}', c) - 1 + ((last + num) % 10) % 3) % 26 + 1], list_append(x, c || num),
    CASE WHEN num > 5 THEN list_concat(y, [upper(c) || (num + 1), upper(c) || (num + 2)]) ELSE list_append(y, upper(c) || (num + 1)) END FROM g WHERE left_ > 0),
seqs AS (SELECT k, x, y FROM g WHERE left_ = 0)"""


def _seqs(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k.alias("k"), (k % 7 + 3).alias("steps"), (k % 10).alias("num"), (k % 26).alias("letter"))
    return sequences.generated(rows, "steps", "num", "letter").select("k", "x", "y")


@query(f"WITH {_SEQS} SELECT k, array_to_string(x, ' ') AS x, array_to_string(y, ' ') AS y FROM seqs")
def q1_generated(spark, d):
    return _seqs(spark, d).select("k", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"WITH {_SEQS}, t AS (SELECT DISTINCT unnest(y) AS token FROM seqs UNION SELECT chr(9) UNION SELECT chr(10)) SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM t")
def q2_vocabulary(spark, d):
    return sequences.vocabulary(_seqs(spark, d), "y", True)


@query(f"WITH {_SEQS} SELECT count(*) AS n, max(len(x)) AS t1, max(len(y)) + 2 AS t2 FROM seqs")
def q2_lengths(spark, d):
    return sequences.lengths(_seqs(spark, d))


@query(
    f"""WITH {_SEQS}, t AS (SELECT DISTINCT unnest(y) AS token FROM seqs UNION SELECT chr(9) UNION SELECT chr(10)), v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM t),
r AS (SELECT k, unnest(list_concat([chr(9)], y, [chr(10)])) AS token, unnest(range(0, len(y) + 2)) - 1 AS t FROM seqs) SELECT k AS n, t, idx AS k FROM r JOIN v USING (token) WHERE t >= 0"""
)
def q3_decoder_target(spark, d):
    rows = _seqs(spark, d)
    return sequences.one_hot(rows, "k", "y", sequences.vocabulary(rows, "y", True), True, 1)


@query(f"WITH {_SEQS} SELECT round(avg((a.y = b.y)::INT), 9) AS accuracy FROM seqs a JOIN seqs b ON b.k = a.k + 70")
def q6_accuracy(spark, d):
    rows = _seqs(spark, d)
    pairs = rows.select("k", F.col("y").alias("want")).join(rows.select((F.col("k") - 70).alias("k"), F.col("y").alias("got")), "k")
    return rounded(sequences.exact_accuracy(pairs, "want", "got"), "accuracy", digits=9)


@query(f"WITH {_SEQS} SELECT k, array_to_string(y, ' ') AS y FROM seqs")
def q5_decode(spark, d):
    """Greedy decoding with a stand-in model: the generator's own rule for the next answer token."""
    from textloom.operators.decode import decode

    return decode(_seqs(spark, d).select("k", "x"), "k", "x")


# ---- sources --------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT c_custkey AS product_id, nullif(nullif(c_name, 'NULL'), '') AS a, nullif(nullif(CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE c_mktsegment END, 'NULL'), '') AS b FROM customer),
keys AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 60 DAY)
SELECT product_id, concat_ws(',', a, b) AS text_note, n_name AS category FROM p JOIN customer ON c_custkey = product_id JOIN nation ON n_nationkey = c_nationkey WHERE length(concat_ws('', a, b)) >= 4 AND product_id IN (SELECT k FROM keys)"""
)
def e1_extract(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").withColumnRenamed("o_custkey", "product_id")
    goods = c.select(F.col("c_custkey").alias("product_id"), "c_name", F.when(F.col("c_custkey") % 3 == 0, "NULL").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    live = F.unix_timestamp(F.lit("1998-06-01"), "yyyy-MM-dd") - products.GRACE
    states = [o.where("o_orderstatus = 'F'"), o.where("o_orderpriority in ('1-URGENT', '2-HIGH')"), o.where(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) >= live)]
    cats = c.join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("product_id"), F.col("n_name").alias("category"))
    return products.extract(goods, "product_id", ["c_name", "c_mktsegment"], states, cats)
