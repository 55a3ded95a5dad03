"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, column, flat, free, mix, run_hashes, slices, trimmed, words
from textloom.llm.langid import bounded_sample

#: Features are hashed into so many weights (4 bytes each, 4 MB in all: the bound of what is broadcast).
BITS = 20
#: The classifier is fitted on about so many labelled documents of each class, whole texts each.
FIT_DOCS = 4000
#: L1 grows with the fitting documents: a coordinate's gradients add up over them.
ALPHA, BETA, L1_A_DOC, L2, EPOCHS = 1.0, 1.0, 0.003, 0.1, 5
CHUNK = 1 << 18


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight index and text of each word, pair of neighbours and pair with one word between, repeats included."""
    starts, ends, first = words(raw, offs)
    h = run_hashes(raw, starts, ends)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    got, where = [h], [of]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = of[gap:] == of[:-gap]
            got.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
            where.append(of[gap:][same])
    return (np.concatenate(got) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(where)


def distinct(feature: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((of << BITS) | feature)
    return both & ((1 << BITS) - 1), both >> BITS


class Ftrl:
    """Per-coordinate rates and L1 sparsity; the last weight is the intercept, which has no L1."""

    def __init__(self, docs: int) -> None:
        self.l1 = L1_A_DOC * docs
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> tuple[np.ndarray, float]:
    """Weights and intercept from documents with a text and a label of 0 or 1 (a labels row of the same key); other rows teach nothing. Of a key with several labels the highest holds.

    A bounded sample of each class's label rows (about FIT_DOCS) is chosen first, so only its keys are broadcast and no text is shuffled; executors hash these texts, one task fits them in an order given by their keys' hashes, and the driver gets the weights that are not zero.
    A key's texts teach each; no key, text or label column need have a certain type or name.
    The intercept is moved from the sample's class shares to those of all labelled rows. One class or no rows: all weights 0, the intercept gives that class.
    """
    known = labels.where(F.col(label).cast("int").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked, counts = bounded_sample(known, "y", FIT_DOCS, "k")
    texts = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("text")).where("text is not null")
    usable = texts.join(F.broadcast(picked), "k").select(F.xxhash64("k").alias("o"), "y", "text")
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                raw, offs = flat(column(part, "text"))
                f, of = distinct(*features(raw, offs))
                ends = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([column(part, "o"), column(part, "y"), lists], names=["o", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            offs, values = column(batch, "f").offsets.to_numpy(), column(batch, "f").values.to_numpy()
            rows += [(o, y, values[a:b].copy()) for o, y, a, b in zip(column(batch, "o").to_pylist(), column(batch, "y").to_pylist(), offs[:-1], offs[1:], strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        n, bad = len(rows), sum(r[1] for r in rows)
        at, w = np.array([1 << BITS]), np.array([8.0 if n and bad == n else -8.0])
        if 0 < bad < n:
            model = fit([(f, y) for _, y, f in rows])
            w = model.weights(np.arange((1 << BITS) + 1))
            at = np.append(np.flatnonzero(w[:-1]), 1 << BITS)
            w = w[at]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([bad], pa.int64()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w.astype(np.float64).tobytes()], pa.binary())], names=["n", "bad", "at", "w"])

    got = usable.mapInArrow(lambda it: trimmed(hashed(it)), "o long, y int, f array<int>").repartition(1).mapInArrow(train, "n long, bad long, at binary, w binary").collect()
    weights = np.zeros(1 << BITS, np.float32)
    if not got:
        return weights, -8.0
    n, bad, at, w = got[0]
    at, w = np.frombuffer(at, np.int32), np.frombuffer(w)
    weights[at[:-1]] = w[:-1]
    shift = np.log(counts[1] / counts[0]) - np.log(bad / (n - bad)) if 0 < bad < n else 0.0
    return weights, float(w[-1] + shift)


def fit(rows: list[tuple[np.ndarray, int]]) -> Ftrl:
    """EPOCHS passes over distinct feature lists and their labels, in the order given."""
    model = Ftrl(len(rows))
    for _ in range(EPOCHS):
        for f, y in rows:
            model.update(np.append(f, 1 << BITS), y)
    return model


def score(docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5). Distinct features of the whole text count once. Null and empty texts score as the intercept alone. Each row is scored by itself, so repeated rows get equal scores; an empty table gives no rows.

    A docs column named score or predicted is replaced; other columns stay, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("score", "predicted")
    low = base.select("*", F.lower(docs[text]).alias(free("__low", *base.columns)))
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(base.schema.fields)), "score double, predicted int"])
    names = [*(f"c{k}" for k in range(len(base.columns))), "score", "predicted"]
    live = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((live, weights[live]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = shared.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = value
        for batch in batches:
            for part in slices(batch, -1, CHUNK):
                raw, offs = flat(column(part, -1))
                f, of = features(raw, offs)
                some = w[f] != 0
                f, of = distinct(f[some], of[some])
                s = intercept + np.bincount(of, weights=w[f], minlength=len(part))
                p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    return low.mapInArrow(lambda it: trimmed(run(it)), schema).toDF(*base.columns, "score", "predicted")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, intercept = learn(docs, labels.where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), weights, intercept).drop("text")
