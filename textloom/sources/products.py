"""Sources: product texts with their sale states, label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that an ended deal still counts as live.
GRACE = 5_184_000


def present(c: Column) -> Column:
    """The column, with the string NULL and empty strings as null."""
    return F.when((c != "NULL") & (c != ""), c)


def extract(products: DataFrame, key: str, texts: list[str], states: list[DataFrame], categories: DataFrame, least: int = 4) -> DataFrame:
    """key, text_note and the category columns of products with enough text that any of the state tables (key) names.

    The states are united into one key set, so that none multiplies rows; the category join may.
    """
    rows = products.where(F.col(key).isNotNull()).withColumn("text_note", F.concat_ws(",", *(present(F.col(c)) for c in texts)))
    rows = rows.where(F.length(F.concat_ws("", *(present(F.col(c)) for c in texts))) >= least).select(key, "text_note")
    keys = states[0].select(key)
    for s in states[1:]:
        keys = keys.unionByName(s.select(key))
    return rows.join(keys.distinct(), key, "left_semi").join(categories, key)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs from tab-separated files."""
    return spark.read.csv(path, sep="\t", schema="target_word string, sim_word string, is_sim int")
