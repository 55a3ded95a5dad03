"""Token sequences for encoder-decoder training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.tfidf import ranked

START, STOP = "\t", "\n"


def vocabulary(seqs: DataFrame, col: str, marks: bool = False) -> DataFrame:
    """token, idx: the distinct tokens in order from 0; with marks, start and stop are tokens too."""
    rows = seqs.select(F.explode(col).alias("token"))
    if marks:
        rows = rows.unionByName(seqs.sparkSession.createDataFrame([(START,), (STOP,)], "token string"))
    return ranked(rows.distinct(), F.col("token"), "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def lengths(seqs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """n, t1, t2: rows, the longest x, and the longest y with start and stop."""
    return seqs.agg(F.count("*").alias("n"), F.max(F.size(x)).alias("t1"), (F.max(F.size(y)) + 2).alias("t2"))


def padded(y: Column) -> Column:
    return F.concat(F.array(F.lit(START)), y, F.array(F.lit(STOP)))


def one_hot(seqs: DataFrame, key: str, col: str, vocab: DataFrame, marks: bool = False, shift: int = 0) -> DataFrame:
    """n, t, k of the ones of the batch tensor; shift 1 gives the decoder's target, one step earlier and without the start."""
    arr = padded(F.col(col)) if marks else F.col(col)
    rows = seqs.select(F.col(key).alias("n"), F.posexplode(arr).alias("t", "token")).withColumn("t", F.col("t") - shift).where("t >= 0")
    return rows.join(vocab, "token").select("n", "t", F.col("idx").alias("k"))


def exact_accuracy(rows: DataFrame, want: str, got: str) -> DataFrame:
    return rows.agg(F.avg((F.col(want) == F.col(got)).cast("int")).alias("accuracy"))


#: The letters of generated questions (fixed value: g occurs twice, j is missing).
ALPHABET = "abcdefghigklmnopqrstuvwxyz"


def generated(rows: DataFrame, steps: str, num: str, letter: str) -> DataFrame:
    """Adds x and y: from a number of steps, a digit and a letter's place, the question's letter-digit tokens and the answer's; a digit over 5 answers twice."""
    letters = F.split(F.lit(ALPHABET), "")
    start = F.struct(F.col(num).cast("int").alias("num"), F.lit(0).alias("last"), F.get(letters, F.col(letter).cast("int")).alias("c"), F.array().cast("array<string>").alias("x"), F.array().cast("array<string>").alias("y"))

    def step(s: Column, _: Column) -> Column:
        c, n = s["c"], s["num"]
        big = F.upper(c)
        answer = F.when(n > 5, F.array(F.concat(big, (n + 1).cast("string")), F.concat(big, (n + 2).cast("string")))).otherwise(F.array(F.concat(big, (n + 1).cast("string"))))
        new = (s["last"] + n) % 10
        at = F.array_position(letters, c).cast("int") - 1
        return F.struct(new.alias("num"), n.alias("last"), F.get(letters, (at + new % 3) % 26).alias("c"), F.concat(s["x"], F.array(F.concat(c, n.cast("string")))).alias("x"), F.concat(s["y"], answer).alias("y"))

    return rows.withColumn("__s", F.aggregate(F.sequence(F.lit(1), F.col(steps).cast("int")), start, step)).withColumn("x", F.col("__s.x")).withColumn("y", F.col("__s.y")).drop("__s")
