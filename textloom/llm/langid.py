"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, column, mix, slices, trimmed

#: Characters of an n-gram.
ORDER = 4
#: The models are fitted on about so many documents of each language, whole texts each (classifier fitting only; a longer text than PIECE characters is counted in pieces).
FIT_DOCS, PIECE = 1000, 1 << 18
#: One in so many fitting documents is left out of the counts and sets the rejection limit.
CALIBRATE = 5
#: Nats a character that a text may lie above the calibrated limit.
SLACK = 0.5
#: Letters assumed for characters that no model has seen.
ALPHABET = 2000
#: Bytes scored at once, and the most that the broadcast models may take.
CHUNK, MOST_MODEL = 1 << 18, 256 << 20


@functools.cache
def _classes() -> np.ndarray:
    """For each code point its lower-case letter, or a space; 0 stays."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0] = 0
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 zeros, other characters as single spaces between letters; and the text of each code point."""
    pad = "\0" * (ORDER - 1)
    joined = pad + pad.join(t.replace("\0", " ") for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _classes()[raw]
    zero = codes == 0
    keep = zero | (codes != 32)
    keep[1:] |= (codes[:-1] != 32) & ~zero[:-1]
    codes, zero = codes[keep], zero[keep]
    return codes, (np.cumsum(zero) - 1) // (ORDER - 1)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place; the first n - 1 places hold no use."""
    acc = np.zeros(len(codes), np.uint64)
    c = codes.astype(np.uint64)
    for k in range(n - 1, -1, -1):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc[k:] += c[: len(c) - k] + np.uint64(1)
    return mix(acc + np.uint64(n))


@dataclass
class Model:
    """Of one or more languages: for each order the sorted hashes of seen n-grams with their interpolated log probabilities, and of contexts with their log back-off weights."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # [n - 1]
    logp: list[np.ndarray] = field(default_factory=list)  # each (keys, langs)
    ctx: list[np.ndarray] = field(default_factory=list)  # contexts of n - 1 characters
    back: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    limit: np.ndarray | None = None

    def size(self) -> int:
        return sum(x.nbytes for part in (self.keys, self.logp, self.ctx, self.back) for x in part)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x, at


def log_prob(model: Model, by_order: list[np.ndarray], n: int = ORDER) -> np.ndarray:
    """Log probability of each place's character after those before it, for each language. by_order[n - 1]: hashes of n-grams ending there; by_order[n + ORDER - 1]: of the n characters before."""
    if n == 0:
        return np.broadcast_to(model.unseen, (len(by_order[0]), len(model.langs)))
    hit, at = _find(model.keys[n - 1], by_order[n - 1])
    out = model.logp[n - 1][at] if len(model.keys[n - 1]) else np.zeros((len(hit), len(model.langs)), np.float32)
    if not hit.all():
        miss = np.flatnonzero(~hit)
        low = log_prob(model, [x[miss] for x in by_order], n - 1).copy()
        if n > 1:
            seen, where = _find(model.ctx[n - 1], by_order[ORDER + n - 2][miss])
            low[seen] += model.back[n - 1][where[seen]]
        else:
            low += model.back[0][0]
        out[miss] = low
    return out


def _ordered(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes for log_prob at the places that are no padding, and these places."""
    place = np.flatnonzero(codes != 0)
    full = [grams(codes, n) for n in range(1, ORDER + 1)]
    return [g[place] for g in full] + [full[n - 1][place - 1] for n in range(1, ORDER)], place


def entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats a character of each text under each language, and its characters. A text without letters has none, and infinite entropy. Long texts are scored in ranges, each with the characters before it."""
    codes, of = letters(texts)
    letter, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    total = np.zeros((len(texts), len(model.langs)))
    for at in range(0, len(codes), PIECE):
        before = min(at, ORDER)
        own, whose = codes[at - before : at + PIECE], of[at - before : at + PIECE]
        orders, place = _ordered(own)
        new = place >= before
        orders, place = [g[new] for g in orders], place[new]
        if not len(place):
            continue
        row = whose[place]
        letter += np.bincount(row[own[place] != 32], minlength=len(texts))
        n += np.bincount(row, minlength=len(texts))
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[first]] += np.add.reduceat(log_prob(model, orders), first, axis=0, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(letter[:, None] > 0, -total / n[:, None], np.inf)
    return h, np.where(letter > 0, n, 0)


def pieces(texts: list[str], most: int = PIECE) -> Iterator[list[str]]:
    """Groups of texts of about `most` characters; a longer text is cut."""
    group, size = [], 0
    for t in texts:
        for k in range(0, len(t), most):
            group.append(t[k : k + most])
            size += len(group[-1])
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def _suffix(rows: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """grams() of the n code points that end `back` before each row's last."""
    acc = np.zeros(len(rows), np.uint64)
    for k in range(n - 1, -1, -1):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, ORDER - 1 - back - k].astype(np.uint64) + np.uint64(1)
    return mix(acc + np.uint64(n))


def count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ORDER code points (rows) that end at some character of the texts, and how often each does."""
    rows, times = np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    for group in pieces(texts):
        codes, _ = letters(group)
        place = np.flatnonzero(codes != 0)
        _, where, c = np.unique(grams(codes, ORDER)[place], return_index=True, return_counts=True)
        rows, times = np.concatenate([rows, codes[place[where][:, None] + np.arange(1 - ORDER, 1)]]), np.concatenate([times, c])
        _, first, back = np.unique(_suffix(rows, ORDER), return_index=True, return_inverse=True)
        rows, times = rows[first], np.bincount(back, weights=times).astype(np.int64)
    return rows, times


def fit(rows: np.ndarray, times: np.ndarray, lang: str) -> Model:
    """Interpolated Kneser-Ney of the counts: raw ones at the highest order, below it the number of distinct characters before an n-gram; one absolute discount an order."""
    model = Model([lang])
    counts = []  # n-gram, a row that ends with it, count
    for n in range(ORDER, 0, -1):
        if n == ORDER:
            key, where = np.unique(_suffix(rows, n), return_index=True)
            c = times[where]
        else:
            last = counts[-1][1]  # one row for each distinct longer n-gram: each is one distinct character before
            key, back, c = np.unique(_suffix(rows[last], n), return_index=True, return_counts=True)
            where = last[back]
        counts.append((key, where, c))
    counts.reverse()
    p_lower = np.zeros(0)
    for n in range(1, ORDER + 1):
        key, where, c = counts[n - 1]
        ones, twos = (c == 1).sum(), (c == 2).sum()
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones and twos else 0.5
        context = _suffix(rows[where], n - 1, 1) if n > 1 else np.zeros(len(where), np.uint64)
        ck, inv, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inv, weights=c, minlength=len(ck))
        gamma = d * kinds / np.maximum(total, 1)
        if n == 1:
            below = np.full(len(key), 1 / ALPHABET)
        else:
            _, at = _find(counts[n - 2][0], _suffix(rows[where], n - 1))
            below = p_lower[at]
        p = np.maximum(c - d, 0) / np.maximum(total, 1)[inv] + gamma[inv] * below if len(ck) else np.zeros(0)
        model.keys.append(key)
        model.logp.append(np.log(p).astype(np.float32)[:, None])
        model.ctx.append(ck)
        model.back.append(np.log(gamma).astype(np.float32)[:, None] if len(ck) else np.zeros((1, 1), np.float32))
        p_lower = p
    model.unseen = np.array([np.log(1 / ALPHABET)], np.float32)
    return model


def join(models: list[Model]) -> Model:
    """One model of all languages: a language without an n-gram gets the probability that it backs off to."""
    models = sorted(models, key=lambda m: m.langs[0])
    out = Model([m.langs[0] for m in models], unseen=np.concatenate([m.unseen for m in models]), limit=np.array([m.limit for m in models], float).ravel())
    for n in range(1, ORDER + 1):
        for name, value, to_key, to_value in (("ctx", "back", out.ctx, out.back), ("keys", "logp", out.keys, out.logp)):
            key = np.unique(np.concatenate([getattr(m, name)[n - 1] for m in models]))
            table = np.full((len(key), len(models)), np.nan if name == "keys" else 0, np.float32)
            for k, m in enumerate(models):
                table[np.searchsorted(key, getattr(m, name)[n - 1]), k] = getattr(m, value)[n - 1][: len(getattr(m, name)[n - 1]), 0]
            to_key.append(key)
            to_value.append(table)
    return out


def _fill(model: Model, rows: np.ndarray, most: int = 1 << 17) -> None:
    """Write into the joint table what a language backs off to for n-grams that only others have seen. rows: the distinct runs of all languages, which hold each n-gram with its context."""
    for at in range(0, len(rows), most):
        own = rows[at : at + most]
        orders = [_suffix(own, n) for n in range(1, ORDER + 1)] + [_suffix(own, n, 1) for n in range(1, ORDER)]
        for n in range(1, ORDER + 1):
            table = model.logp[n - 1]
            hit, row = _find(model.keys[n - 1], orders[n - 1])
            row, first = np.unique(row[hit], return_index=True)
            where = np.flatnonzero(hit)[first]
            some = np.isnan(table[row]).any(axis=1)
            row, where = row[some], where[some]
            low = log_prob(model, [x[where] for x in orders], n - 1).copy()
            if n > 1:
                seen, c = _find(model.ctx[n - 1], orders[ORDER + n - 2][where])
                low[seen] += model.back[n - 1][c[seen]]
            else:
                low += model.back[0][0]
            table[row] = np.where(np.isnan(table[row]), low, table[row])
    for table in model.logp:
        np.nan_to_num(table, copy=False, nan=float(model.unseen.min()))


def bounded_sample(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """About `most` rows of each label, chosen by a hash of the key, and the rows of each label. Labels are assumed few."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)), counts


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on rows with a text and a language. Each language's bounded sample is counted in a task of its own; the driver gets the finished arrays only.

    Rows with a null text or language teach nothing; repeated rows count each. No usable rows: a model without languages, which answers und.
    """
    usable = rows.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
    picked, _ = bounded_sample(usable, "lang", FIT_DOCS, "k")

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        frame = frame.sort_values("k")
        name = frame["lang"].iloc[0]
        texts = frame["text"].tolist()
        rows, times = count([t for i, t in enumerate(texts) if i % CALIBRATE or len(texts) < 2 * CALIBRATE])
        model = fit(rows, times, name)
        h = [h[n >= 20, 0] for h, n in (entropies(model, [t]) for t in texts[::CALIBRATE])]
        h = np.concatenate(h) if h else np.zeros(0)
        model.limit = np.array([h.max() + SLACK if len(h) else np.inf])
        return pd.DataFrame({"lang": [name], "model": [pickle.dumps(model)], "rows": [rows.tobytes()]})

    import pickle

    got = picked.groupBy("lang").applyInPandas(train, "lang string, model binary, rows binary").collect()
    if not got:
        return Model([])
    model = join([pickle.loads(r["model"]) for r in got])
    _fill(model, np.concatenate([np.frombuffer(r["rows"], np.uint32).reshape(-1, ORDER) for r in got]))
    if model.size() > MOST_MODEL:
        raise ValueError(f"language models of {model.size()} bytes exceed the broadcast bound; lower FIT_DOCS")
    return model


NEW = ("lang_pred", "score", "entropy", "rejected")


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (0 to 1), entropy (nats a character, null where none) and rejected, each after the prefix.

    lang_pred has the lowest length-normalised cross-entropy over the whole text; ties go to the language first in the alphabet. Long texts are scored in ranges, with the same result. Each row is judged by itself, so repeated rows get equal answers; an empty table gives no rows.
    A null text, or one without letters: und, score 0, rejected. A text far above its language's calibrated entropy keeps its best language but is rejected.
    Columns of docs stay as they are; a docs column that has one of the new names is replaced.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop(*(prefix + c for c in NEW))
    place = base.columns.index(text)
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(base.schema.fields)), "lang_pred string, score double, entropy double, rejected boolean"])
    names = [*(f"c{k}" for k in range(len(base.columns))), *NEW]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, place, CHUNK):
                texts = column(part, place).fill_null("").to_pylist()
                if m.langs:
                    h, n = entropies(m, texts)
                else:
                    h, n = np.full((len(texts), 1), np.inf), np.zeros(len(texts), np.int64)
                best = h.argmin(axis=1)
                low = h[np.arange(len(h)), best]
                ok = n > 0
                z = np.where(ok[:, None], (low[:, None] - h) * np.minimum(n, 100)[:, None], 0)
                score = np.where(ok, 1 / np.exp(z).sum(axis=1), 0.0)
                bar = (m.limit[best] if m.langs else np.zeros(len(h))) + 3 / np.sqrt(np.maximum(n, 1))
                langs = np.array([*m.langs, "und"], object)[np.where(ok, best, len(m.langs))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(low, mask=~ok), pa.array(~ok | (low > bar))], names=names)

    return base.mapInArrow(lambda it: trimmed(run(it)), schema).toDF(*base.columns, *(prefix + c for c in NEW))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is recognised, with the columns they came with."""
    model = learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    prefix = "lid_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return identify(docs, model, prefix=prefix).where(~F.col(f"{prefix}rejected")).select(*docs.columns)
