"""Token counts: batches balanced by bytes go through the tokenizer inside Arrow functions that return lengths only."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, flat, free, run_hashes, same_bytes, slices, trimmed

#: Bytes of text that are split and counted together; a longer text is cut at safe places.
BATCH_BYTES = 1 << 20
#: Distinct units, bytes of long ones and values that a task remembers before it starts anew.
UNITS, POOL = 1 << 19, 16 << 20


@functools.cache
def _sentencepiece(path: str):
    """The processor, and whether no piece has a space after another character, so that text may be cut before any space that follows one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    safe = not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.vocab_size()))
    probe = ["a  b c", " a", "a ", "  ", "x y  z "]
    safe &= all(sum(len(sp.encode(u)) if u != "\0" else 1 for u in units(t)) == len(sp.encode(t)) for t in probe)
    return sp, safe


def units(text: str) -> list[str]:
    """Reference form of the cutting: before each space that follows a non-space. The model's own leading marker stands for a later unit's first space; a lone space is given as NUL."""
    cuts = [0] + [i for i in range(1, len(text)) if text[i] == " " != text[i - 1]] + [len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return parts[:1] + [p[1:] or "\0" for p in parts[1:]]


def unit_keys(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of units: up to 7 bytes the bytes and their number, so equal keys are equal units; a longer unit's hash with the highest bit set, which only says where to compare bytes."""
    size = end - begin
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[begin]
    short = np.minimum(size, 7).astype(np.uint64)
    key = (eight & ((np.uint64(1) << (short * np.uint64(8))) - np.uint64(1))) | (short << np.uint64(56))
    far = np.flatnonzero(size > 7)
    key[far] = run_hashes(raw, begin[far], end[far]) | np.uint64(1 << 63)
    return key


class Units:
    """What a task remembers of distinct units: n and values of each, found by key and, for units over 7 bytes, only if all bytes are the same."""

    def __init__(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.at, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.n, self.start, self.values, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def slots(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, learn) -> np.ndarray:
        """The slot of each unit. learn gets the texts of units not remembered and returns the n, the values and the goodness of each."""
        if len(self.n) > UNITS or len(self.pool) > POOL or len(self.values) > POOL // 4:
            self.__init__()
        key, size = unit_keys(raw, begin, end), end - begin
        uniq, where, back = np.unique(key, return_index=True, return_inverse=True)
        far = np.flatnonzero(key >> np.uint64(63))
        lead = where[back[far]]
        odd = far[(size[far] != size[lead]) | ~same_bytes(raw, begin[far], raw, begin[lead], np.where(size[far] == size[lead], size[far], 0))]
        slot = np.full(len(uniq), -1)
        fresh = np.ones(len(uniq), bool)
        if len(self.key):
            place = np.minimum(np.searchsorted(self.key, uniq), len(self.key) - 1)
            fresh = self.key[place] != uniq
            known = np.flatnonzero(~fresh)
            found = self.slot[place[known]]
            long = uniq[known] >> np.uint64(63) == 1
            equal = ~long | (self.size[found] == size[where[known]])
            look = np.flatnonzero(equal & long)
            equal[look] = same_bytes(raw, begin[where[known[look]]], self.pool, self.at[found[look]], self.size[found[look]])
            slot[known[equal]] = found[equal]
        todo = np.flatnonzero(slot < 0)
        new = np.concatenate([where[todo], odd])
        if len(new):
            first = len(self.n)
            self._add(raw, begin[new], size[new], learn)
            slot[todo] = first + np.arange(len(todo))
            keep = todo[fresh[todo]]
            both, at = np.concatenate([self.key, uniq[keep]]), np.concatenate([self.slot, slot[keep]])
            order = np.argsort(both, kind="stable")
            self.key, self.slot = both[order], at[order]
        out = slot[back]
        out[odd] = len(self.n) - len(odd) + np.arange(len(odd))
        return out

    def _add(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, learn) -> None:
        data = raw.tobytes()
        for k in range(0, len(begin), 65536):
            b, z = begin[k : k + 65536], size[k : k + 65536]
            n, values, good = learn([data[x : x + y].decode() for x, y in zip(b.tolist(), z.tolist(), strict=True)])
            kept = np.where(z > 7, z, 0)
            total = np.cumsum(kept)
            more = raw[np.arange(total[-1]) + np.repeat(b - (total - kept), kept)]
            self.at, self.pool, self.size = np.concatenate([self.at, len(self.pool) + total - kept]), np.concatenate([self.pool, more]), np.concatenate([self.size, z])
            self.start = np.concatenate([self.start, len(self.values) + np.cumsum(n) - n])
            self.n, self.values, self.good = np.concatenate([self.n, n]), np.concatenate([self.values, values]), np.concatenate([self.good, good])


def _safe(raw: np.ndarray) -> np.ndarray:
    """For each byte but the first: a space after another character. The marker itself, U+2581 or e2 96 81, counts as a space."""
    space = raw == 32
    before = space.copy()
    before[2:] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
    return space[1:] & ~before[:-1]


def cut_units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the units that texts fall into at safe places, and begins and ends of what is encoded of each: a later unit's first space is the model's own leading marker."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = _safe(raw)
    head = np.zeros(len(raw) + 1, bool)
    head[offs] = True
    starts = np.flatnonzero((cut | head)[:-1])
    ends = np.append(starts[1:], len(raw))
    return starts, np.where(head[starts], starts, starts + 1), ends[: len(starts)]


def _count_units(raw: np.ndarray, offs: np.ndarray, sp, known: Units) -> np.ndarray:
    """Tokens of each text: the texts are cut at all safe places, and each distinct unit is encoded once."""
    starts, begin, ends = cut_units(raw, offs)
    if not len(starts):
        return np.zeros(len(offs) - 1, np.int64)

    def learn(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, sp.encode(texts, num_threads=1)), np.int64, len(texts))
        return np.where(n == 0, 1, n), np.zeros(0, np.int32), np.ones(len(n), bool)  # a lone space: one marker

    slot = known.slots(raw, begin, ends, learn)
    total = np.r_[0, np.cumsum(known.n[slot])]
    return np.diff(total[np.searchsorted(starts, offs)])


def _pieces(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts up to BATCH_BYTES; a longer one in parts that start with a kept space at a safe place."""
    if offs[-1] <= BATCH_BYTES or len(offs) > 2:
        yield raw, offs
        return
    safe = np.flatnonzero(_safe(raw)) + 1
    at = 0
    while at < len(raw):
        to = len(raw)
        if to - at > BATCH_BYTES and (k := np.searchsorted(safe, at + BATCH_BYTES)) < len(safe):
            to = int(safe[k])
        yield raw[at:to], np.array([0, to - at])
        at = to


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes and n_tokens of each text, as sentencepiece (.model) or tokenizers (.json) gives them.

    Distinct units are encoded once a task and found again by all their bytes.
    No begin, end or added special tokens, no truncation or padding. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each.
    Texts longer than a batch are cut before spaces that follow non-spaces, where no token of the model can cross (checked on the model; else whole texts are encoded).
    Only the keep columns and the text are read, so other columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias(free("__text", *keep)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units()
        if model_path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(model_path)
            tok.encode_special_tokens = True
            tok.no_truncation()
            tok.no_padding()
        else:
            sp, safe = _sentencepiece(model_path)
        for batch in batches:
            for part in slices(batch, -1, BATCH_BYTES):
                raw, offs = flat(part.column(part.num_columns - 1))
                if model_path.endswith(".json"):
                    n = np.array([len(e) for e in tok.encode_batch(part.column(part.num_columns - 1).fill_null("").to_pylist(), add_special_tokens=False)], np.int64)
                elif not safe:
                    n = np.array([len(e) for e in sp.encode(part.column(part.num_columns - 1).fill_null("").to_pylist(), num_threads=1)], np.int64)
                elif len(part) > 1:
                    n = _count_units(raw, offs, sp, known)
                else:
                    n = np.zeros(1, np.int64)
                    for k, (r, o) in enumerate(_pieces(raw, offs)):
                        # a later part starts with its space, which the marker at its head stands for
                        n += _count_units(r[1:] if k else r, o - (k > 0) * np.array([0, 1]), sp, known) if len(r) > (k > 0) else (k > 0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(offs)), pa.array(n)], names=[*part.schema.names[:-1], "n_bytes", "n_tokens"])

    return src.mapInArrow(lambda it: trimmed(run(it)), schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
