"""Temporal URL lists: dated entries become validity intervals, and every capture is judged by the entries active when it was fetched. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a final dot; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def path_parts(url: Column) -> Column:
    """Non-empty path segments of a URL, without query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def url_keys(url: Column) -> Column:
    """Distinct list keys that can match a URL: its host, each parent domain, and host plus leading path segments, at every depth. Their number is bounded by the URL's length."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    parts = path_parts(url)
    m = F.size(parts)
    prefixes = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda k: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(domains, F.array(h), prefixes))).otherwise(F.array().cast("array<string>"))


def _shape(key: Column) -> Column:
    """Labels of a key's host and segments of its path, as one number."""
    labels = F.size(F.split(F.substring_index(key, "/", 1), r"\."))
    return labels * 65536 + F.size(F.split(key, "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows list, key, day, action (add or remove) to half-open intervals list, key, since, until (null: still active).

    Of several rows of a day, a remove wins; repeated adds change nothing. Rows with a null list, key or day, or another action, are ignored.
    """
    clean = entries.where("action in ('add', 'remove') and list is not null and key is not null and day is not null")
    daily = clean.groupBy("list", "key", "day").agg(F.max("action").alias("action"))  # remove > add
    w = Window.partitionBy("list", "key").orderBy("day")
    turns = daily.withColumn("was", F.lag("action").over(w)).where("was is null or was <> action")
    return turns.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("list", "key", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """id, n_active, lists (sorted names of the lists with an entry for the URL that is active on the day of the fetch) and blocked, a row for each capture row's id.

    The join is on key and year: intervals are cut at year ends, so a common host's captures and a busy entry's intervals meet only within a year, and AQE splits what is still large.
    A capture without a usable URL or fetch day matches nothing: n_active 0, no lists, not blocked. Rows that repeat an id are judged together, as one. Ids that are null give one row.
    """
    spans = intervals(entries)
    end = captures.agg(F.max(F.year(fetched)).alias("top"), F.min(F.year(fetched)).alias("low"))  # one row: cuts spans to years with captures
    spans = spans.crossJoin(F.broadcast(end)).withColumn("from", F.greatest(F.year("since"), F.col("low"))).withColumn("to", F.least(F.coalesce(F.year(F.date_sub("until", 1)), F.col("top")), F.col("top")))
    spans = spans.where("`from` <= `to`").select("list", "key", "since", "until", F.explode(F.sequence("from", "to")).alias("year"))
    keyed = captures.select(F.col(id).alias("id"), F.col(fetched).alias("f"), F.year(fetched).alias("year"), F.explode(url_keys(F.col(url))).alias("key"))
    # keys of a shape that no entry has, such as bare top-level domains, need not travel; the shapes are at most as many as a host has labels times a path has segments
    shapes = spans.agg(F.collect_set(_shape(F.col("key"))).alias("shapes"))
    keyed = keyed.crossJoin(F.broadcast(shapes)).where(F.array_contains("shapes", _shape(F.col("key")))).drop("shapes")
    hits = keyed.join(spans, ["key", "year"]).where("f >= since and (until is null or f < until)")
    found = hits.groupBy("id").agg(F.count_distinct("list", "key").alias("n"), F.array_sort(F.collect_set("list")).alias("l"))
    every = captures.select(F.col(id).alias("id")).distinct()
    out = every.join(found, every["id"].eqNullSafe(found["id"]), "left").select(every["id"].alias(id), "n", "l")
    return out.select(id, F.coalesce("n", F.lit(0)).alias("n_active"), F.coalesce("l", F.array().cast("array<string>")).alias("lists"), F.col("n").isNotNull().alias("blocked"))


# ---- the query ------------------------------------------------------------------------------------------------------
# Pages carry no fetch day and no list comes with them, so both follow from hashes: hosts are added to and removed from three lists, and so are some domains and paths.


def _number(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def _entries(pages: DataFrame) -> DataFrame:
    names = pages.select(F.explode(url_keys(F.col("url"))).alias("key")).distinct()
    turns = F.array(*(F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), F.lit(at).alias("at"), F.lit(one_of).alias("one_of")) for name, action, at, one_of in _TURNS))
    rows = names.select("key", F.explode(turns).alias("t")).where((_number(F.concat("t.list", "key"), 29) % F.col("t.one_of")) == 0)
    return rows.select("t.list", "key", F.date_add(F.lit("2019-01-01").cast("date"), F.expr("cast(conv(substring(md5(concat(t.list, key)), t.at, 4), 16, 10) as int) % 2000")).alias("day"), "t.action")


#: List, action, place of the day's hash, and one key in so many gets such entries.
_TURNS = [("adult", "add", 1, 3), ("adult", "remove", 5, 3), ("malware", "add", 1, 2), ("malware", "remove", 5, 2), ("malware", "add", 9, 4), ("spam", "add", 13, 5)]


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(2200)).cast("int"))
    return judge(pages.withColumn("fetched", day), _entries(pages)).withColumn("lists", F.array_join("lists", ","))


OP7_SQL = (
    r"""
WITH parsed AS (
  SELECT page_id, DATE '2019-01-01' + CAST((page_id * 37) % 2200 AS INTEGER) AS f,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
labels AS (SELECT *, string_split(host, '.') AS lab FROM parsed WHERE host IS NOT NULL),
keyed AS (
  SELECT page_id, f, array_to_string(lab[len(lab) - k + 1:], '.') AS key FROM (SELECT *, unnest(range(1, len(lab) + 1)) AS k FROM labels)
  UNION SELECT page_id, f, host FROM labels
  UNION SELECT page_id, f, host || '/' || array_to_string(parts[1:k], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM labels)),
turns(list, action, place, one_of) AS (VALUES """
    + ", ".join(map(str, _TURNS))
    + r"""),
entries AS (
  SELECT list, key, action, DATE '2019-01-01' + CAST(CAST('0x' || substring(md5(list || key), place, 4) AS INTEGER) % 2000 AS INTEGER) AS day
  FROM (SELECT DISTINCT key FROM keyed), turns WHERE CAST('0x' || substring(md5(list || key), 29, 4) AS INTEGER) % one_of = 0),
daily AS (SELECT list, key, day, max(action) AS action FROM entries GROUP BY ALL),
hits AS (
  SELECT k.page_id, d.list, k.key FROM keyed k JOIN daily d ON d.key = k.key AND d.day <= k.f
  GROUP BY k.page_id, d.list, k.key HAVING arg_max(d.action, d.day) = 'add')
SELECT p.page_id, count(h.list) AS n_active, coalesce(array_to_string(list_sort(list(DISTINCT h.list) FILTER (h.list IS NOT NULL)), ','), '') AS lists, count(h.list) > 0 AS blocked
FROM (SELECT DISTINCT page_id FROM pages) p LEFT JOIN hits h ON h.page_id = p.page_id GROUP BY p.page_id
"""
)
