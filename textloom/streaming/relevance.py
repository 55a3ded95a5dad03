"""Relevance summaries over a stream of texts: each micro-batch adds its pair sums to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.relevance import all_pairs


def accumulate(stream: DataFrame, path: str, checkpoint: str, targets: DataFrame | None = None) -> StreamingQuery:
    """stream(doc, tokens); a doc must not be split over batches. Batches are written under their number, so a repeated one replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        sums = all_pairs(batch, targets).groupBy("flag_word", "target_word").agg(F.sum("each").alias("sum_relevance"), F.count("*").alias("total_num"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("flag_word", "target_word").agg(F.sum("sum_relevance").alias("sum_relevance"), F.sum("total_num").alias("total_num"))
