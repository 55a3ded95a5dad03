"""Longest-match segmentation against a dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a broadcast dictionary may hold.
MOST_WORDS = 2_000_000


def longest(text: str, known: dict, most: int) -> list[str]:
    """From each place the longest known word, or one character."""
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(min(most, len(text) - i), 1, -1) if text[i : i + n] in known), 1)
        out.append(text[i : i + n])
        i += n
    return out


#: The flag of what no dictionary word covers.
UNKNOWN = "x"


def segment(docs: DataFrame, words: DataFrame, word: str, text: str = "text", flag: str | None = None) -> DataFrame:
    """docs with `words`: array<string>, or with the dictionary's column of flags array<struct<word,flag>>, where unknown characters have UNKNOWN. Of a word with several flags the least holds. The dictionary's size is checked before it is broadcast."""
    if words.count() > MOST_WORDS:
        raise ValueError(f"a dictionary of over {MOST_WORDS} words is not broadcast")
    entries = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("w")).agg(F.min(flag if flag else F.lit(None).cast("string")).alias("f")).collect()
    known = {r["w"]: r["f"] or UNKNOWN for r in entries}
    shared = docs.sparkSession.sparkContext.broadcast((known, max(map(len, known), default=1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + (", words array<struct<word:string,flag:string>>" if flag else ", words array<string>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = [longest(t or "", *shared.value) for t in frame[text]]
            yield frame.assign(words=[[{"word": w, "flag": shared.value[0].get(w, UNKNOWN)} for w in x] for x in cut] if flag else cut)

    return docs.mapInPandas(run, schema)
