"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model's protobuf."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import bounded_batches, column, flat, free, slices, trimmed
from textloom.llm.tokens import Units, cut_units

#: Bytes of text encoded at once, and the longest text that is compared as a whole with sentencepiece, one a chunk.
CHUNK, WHOLE = 1 << 20, 1 << 14
#: Threads of a worker's batches: executors run several workers, and each thread keeps memory of its own.
THREADS = 2
#: Kinds of pieces in the protobuf (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Kinds of models in the protobuf (fixed values).
UNIGRAM, BPE = 1, 2


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


@functools.cache
def build(path: str):
    """A tokenizers.Tokenizer with the ids of the sentencepiece model, and whether text may be cut before a space that follows another character.

    Normaliser: the precompiled character map, removal of extra spaces, the leading marker and the markers for spaces, each as the protobuf asks.
    Unigram models keep their scores; BPE models get the merges that their scores rank. Both fall back to bytes where the model does.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    proto = read_model(path)
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unk, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        real = {p for p, _, t in pieces if t in (NORMAL, USER_DEFINED)}
        merges = [(-s, i, vocab[p[:k]], p[:k], p[k:]) for i, (p, s, t) in enumerate(pieces) if t == NORMAL for k in range(1, len(p)) if p[:k] in real and p[k:] in real]
        model = models.BPE(vocab, [m[3:] for m in sorted(merges)], unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend("▁"))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", "▁"))
    tok = Tokenizer(model)
    tok.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace("▁", " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    safe = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and not any("▁" in p.lstrip("▁") for p, _, t in pieces if t in (NORMAL, USER_DEFINED))
    return tok, safe


def verify(path: str, texts: list[str]) -> None:
    """Raise unless the rebuilt tokenizer and sentencepiece give the same ids and, back, the same texts."""
    import sentencepiece

    sp, (tok, _) = sentencepiece.SentencePieceProcessor(model_file=path), build(path)
    want = sp.encode(texts)
    got = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    bad = [t for t, a, b in zip(texts, want, got, strict=True) if a != b or sp.decode(a) != tok.decode(b, skip_special_tokens=False)]
    if bad:
        raise ValueError(f"ids or texts differ from sentencepiece: {bad[:3]!r}")


#: Texts that a worker checks before it encodes: markers, runs of spaces, bytes, other scripts, control pieces as plain text.
PROBES = ["", " ", "a", "Hello  world ", " lead", "\t\n x", "<s> </s> <unk>", "naïve Größe œuvre", "▁a ▁ b", "𝒳 字漢 한글 🙂", "\x00\x01", "1234 $5.00"]


def _gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges at:at+n of the pool, one after the other."""
    to = np.cumsum(n)
    return pool[np.arange(to[-1] if len(to) else 0) + np.repeat(at - (to - n), n)]


def _ids(tok, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    got = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    n = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter((i for x in got for i in x), np.int32, int(n.sum())), n


def encode_flat(raw: np.ndarray, offs: np.ndarray, tok, sp, marker: int, known: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the number of each, and whether decoding gives each text again (with spaces for U+2581).

    Each distinct unit between safe cuts is encoded, compared with sentencepiece and decoded once a task, in multithreaded batches. A unit is whole characters and starts with the marker, so a text's decoding is its units' decodings in a row.
    """
    starts, begin, ends = cut_units(raw, offs)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64), np.ones(len(offs) - 1, bool)

    def learn(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, n = _ids(tok, texts)
        if not np.array_equal(ids, np.array([i for x in sp.encode(texts, num_threads=1) for i in x], np.int32)):
            raise ValueError("ids differ from sentencepiece")
        lone = np.flatnonzero(n == 0)  # a lone space: the marker itself
        ids, n = np.insert(ids, np.cumsum(n)[lone], marker).astype(np.int32), np.where(n == 0, 1, n)
        flat_ids, edges = ids.tolist(), [0, *np.cumsum(n).tolist()]
        back = tok.decode_batch([flat_ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], skip_special_tokens=False)
        return n, ids, np.fromiter((a == b.replace("▁", " ") for a, b in zip(back, texts, strict=True)), bool, len(texts))

    slot = known.slots(raw, begin, ends, learn)
    n = known.n[slot]
    first = np.searchsorted(starts, offs)
    bad = np.r_[0, np.cumsum(~known.good[slot])]
    total = np.r_[0, np.cumsum(n)]
    return _gather(known.values, known.start[slot], n), np.diff(total[first]), np.diff(bad[first]) == 0


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """docs with the ids of each text (array<int>); a null or empty text has none. Special strings in a text are plain text; nothing is added or truncated.

    With check, a column of that name tells whether decoding the ids gives the text again (with spaces for U+2581, which the model can't tell from them; null counts as empty).
    All ids are compared with sentencepiece where they are made: each distinct unit of a task, and one whole text a chunk; a difference raises.

    A docs column named like the new one is replaced; other columns stay. Whole texts are encoded, a chunk of at most CHUNK bytes, or one text, at a time.
    """
    import sentencepiece

    bounded_batches(docs.sparkSession)
    base = docs.drop(ids, *([check] if check else []))
    src = base.select("*", docs[text].alias(free("__text", *base.columns)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", `{ids}` array<int>" + (f", `{check}` boolean" if check else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        tok, safe = build(path)
        verify(path, PROBES)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        marker, known = tok.token_to_id("▁"), Units()
        for batch in batches:
            for part in slices(batch, -1, CHUNK):
                texts = column(part, -1).fill_null("")
                if safe and marker is not None:
                    got, n, same = encode_flat(*flat(texts), tok, sp, marker, known)
                else:
                    got, n = _ids(tok, texts.to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(got, pa.int32()))
                if not (safe and marker is not None):
                    back = [t for k in range(0, len(part), 64) for t in tok.decode_batch(lists.slice(k, 64).to_pylist(), skip_special_tokens=False)]
                    same = np.array([a == b.replace("▁", " ") for a, b in zip(back, texts.to_pylist(), strict=True)], bool)
                some = next((k for k, size in enumerate(np.diff(flat(texts)[1]).tolist()) if 0 < size <= WHOLE), None)
                if some is not None and lists[some].as_py() != sp.encode(texts[some].as_py()):
                    raise ValueError("ids of a whole text differ from sentencepiece")
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *([pa.array(same)] if check else [])], names=[*part.schema.names[:-1], ids, *([check] if check else [])])

    return src.mapInArrow(lambda it: trimmed(run(it)), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of each id list; a null or empty list gives an empty text, control pieces give their own strings. A docs column named like the new one is replaced."""
    base = docs.drop(text)
    src = base.select("*", docs[ids].alias(free("__ids", *base.columns)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = build(path)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                got = tok.decode_batch([x or [] for x in column(part, -1).to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.string())], names=[*part.schema.names[:-1], text])

    return src.mapInArrow(run, schema)


def _encoded(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), check="round_trip")
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "round_trip", "ids")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return _encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every kept document."""
    return _encoded(docs.select("doc_id", "text"))
