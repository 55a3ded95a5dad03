"""Greedy decoding of sequences with a model that is called a step at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from textloom.operators.sequences import START, STOP


def own_rule(x: list[str], so_far: list[str]) -> str:
    """A stand-in model: the token that the generator's rule puts next."""
    answer = [t[0].upper() + str(int(t[1:]) + k) for t in x for k in ((1, 2) if int(t[1:]) > 5 else (1,))]
    at = len(so_far) - 1
    return answer[at] if at < len(answer) else STOP


def decode(seqs: DataFrame, key: str, col: str, model: Callable[[list[str], list[str]], str] = own_rule, most: int = 64) -> DataFrame:
    """key, y: from the start token on the model's next token until it says stop, or `most` tokens are there. A trained model's object comes in through `model`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x in frame[col]:
                out = [START]
                while len(out) <= most and (t := model(list(x), out)) != STOP:
                    out.append(t)
                rows.append(" ".join(out[1:]))
            yield pd.DataFrame({key: frame[key], "y": rows})

    return seqs.select(key, col).mapInPandas(run, f"`{key}` {dict(seqs.dtypes)[key]}, y string")
