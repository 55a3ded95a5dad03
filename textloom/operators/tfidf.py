"""Term statistics and TF-IDF vectors of topics, in long form (doc, term, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import real_term
from textloom.session import cut


def term_counts(docs: DataFrame, doc: str = "doc", toks: str = "tokens") -> DataFrame:
    """doc, term, n. Rows of one doc add up; a null or empty token list adds nothing."""
    return docs.select(F.col(doc).alias("doc"), F.explode(toks).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))


def term_stats(counts: DataFrame, min_tf: int = 3) -> DataFrame:
    """term, tf, df of terms with more than min_tf occurrences."""
    return counts.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).where(F.col("tf") > min_tf)


def log2(x: Column) -> Column:
    """The C library's logarithm, as SQL has it; F.log2 divides two natural logarithms, which moves its last digit."""

    def of(s: pd.Series) -> pd.Series:
        at, values = s.factorize()
        return pd.Series(np.append([math.log2(v) for v in values], np.nan)[at], dtype="float64")

    return F.pandas_udf(of, "double")(x)


def weights(counts: DataFrame, min_tf: int = 3) -> DataFrame:
    """doc, term, w: tf times log2(D / df), scaled by the doc's largest, then by the term's largest; terms with over min_tf occurrences.

    A term in all docs has no weight anywhere: null, so that it is in no vector, but stays in the relation of terms and docs.
    """
    counts, term = cut(counts), Window.partitionBy("term")
    size = counts.agg(F.count_distinct("doc").alias("docs"))
    totals = counts.groupBy("doc").agg(F.sum("n").alias("total"))
    rows = counts.withColumns({"tf": F.sum("n").over(term), "df": F.count("*").over(term)}).join(totals, "doc").crossJoin(F.broadcast(size))  # size is one row
    raw = cut(rows.withColumn("x", F.col("n") / F.col("total") * log2(F.col("docs") / F.col("df"))).select("doc", "term", "tf", "df", "docs", "x"))
    most = raw.groupBy("doc").agg(F.max("x").alias("most"))
    by_doc = raw.where(F.col("tf") > min_tf).join(most, "doc").withColumn("y", F.try_divide("x", "most"))
    top = by_doc.withColumn("top", F.max("y").over(term))
    return top.select("doc", "term", F.when(F.col("df") < F.col("docs"), F.try_divide("y", "top")).alias("w"))


def vectors(w: DataFrame) -> DataFrame:
    """term, values, docs: the non-zero weights of a term in order of docs."""
    some = w.where(F.coalesce(F.col("w") != 0, F.lit(False)))
    rows = some.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc", "w"))).alias("v"))
    return rows.select("term", F.transform("v", lambda s: s["w"]).alias("values"), F.transform("v", lambda s: s["doc"]).alias("docs"))


def ranked(rows: DataFrame, by: Column, to: str, *then: str) -> DataFrame:
    """rows with their place from 1 in the order of the string `by`, and of columns after it where that is equal. Only the counts of the strings' first two characters go through one task."""
    first = rows.withColumn("__by", by).withColumn("__head", F.substring("__by", 1, 2))
    sizes = first.groupBy("__head").count()
    before = sizes.select("__head", (F.sum("count").over(Window.orderBy("__head")) - F.col("count")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__head").orderBy("__by", *then))
    out = first.withColumn("__own", own).join(before, "__head").withColumn(to, (F.col("__base") + F.col("__own")).cast("long"))
    return out.drop("__by", "__head", "__base", "__own")


def numbered(stats: DataFrame) -> DataFrame:
    """Real terms with their rank in the alphabet."""
    return ranked(stats.where(real_term(F.col("term"))).select("term"), F.col("term"), "rankx")


def topic_corpus(docs: DataFrame, topic: str, toks: str) -> DataFrame:
    """doc, tokens: the distinct token lists of a topic, one after the other in their own order."""
    rows = docs.where(F.col(topic).isNotNull() & F.col(toks).isNotNull()).select(F.col(topic).alias("doc"), F.col(toks).alias("t")).distinct()
    return rows.groupBy("doc").agg(F.flatten(F.array_sort(F.collect_list("t"))).alias("tokens"))
