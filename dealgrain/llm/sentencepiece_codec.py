"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protocol buffer is read here, field by field. From it are rebuilt the normaliser (precompiled map, runs
of blanks, dummy prefix), the metaspace marker, the model (unigram with its scores, or byte-pair merges, each way of
joining two pieces into a third ranked by the third's score) and byte fallback. Texts are encoded in batches by the
library's threads. Where no piece of the vocabulary has the marker after another symbol, texts are split before markers
first, which changes no result and lets the library keep the pieces of frequent words.

Where the model neither maps nor squeezes characters, a text is cut before its runs of blanks, equal cuts are encoded
once and their numbers kept (at most ``KEPT`` cuts a process, then anew); cuts are told apart by a hash of 64 bits. Other
models, and texts that hold the marker itself or a zero byte, are encoded whole.

``parity`` holds the backend against the sentencepiece library; queries run it on probe texts before they encode.

Null gives null pieces, -1 for their number and a null round trip; an empty text gives no piece. Texts of any length are
encoded whole; strings that look like control pieces are ordinary text. Repeated rows give repeated results, an empty
table an empty result, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import need
from .textvec import mix, pieces, powers, trim

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
KEPT = 1_000_000
THREADS = 2
_PART = "\0"
_FIRST = np.uint64(0xA24BAED4963EE407)


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: a varint as int, anything else as bytes."""

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[at]
            x |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return x, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                n, at = varint(at)
            else:
                n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    if m.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """All joins of two pieces, best score first; of equal scores the longer result, which joins runs from the left."""
    known = {p for p, _, kind in m.pieces if kind in (NORMAL, USER)}
    ranked = sorted((-score, -len(p), i, p) for i, (p, score, kind) in enumerate(m.pieces) if kind == NORMAL and len(p) > 1)
    return [(p[:k], p[k:]) for _, _, _, p in ranked for k in range(1, len(p)) if p[:k] in known and p[k:] in known]


def build(m: Model, prefix: bool = True):
    """A ``tokenizers.Tokenizer`` with the model's results."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.model_type == BPE:
        tok = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback))
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if m.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [p for p, _, kind in m.pieces if kind == USER]
    if user:
        tok.add_tokens([AddedToken(p, normalized=True) for p in user])
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix and prefix else [])])
    return tok


_HELD: dict[str, object] = {}


def tokenizer(data: bytes, threads: int = 1):
    """The backend for a model file's bytes, built once a process, with that many threads."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        _HELD[key] = build(parse(data))
    return _HELD[key]


PROBES = ["", " ", "The model", "  two  blanks ", "tab\tand\nline\n\nends", "naïve Éclair ß ñandú", "汉字かな한국어", "🙂 emoji 👩‍👩‍👧", "<s> </s> <unk> <0x41>", "1234567890 3.14", " " * 15 + "x" + " " * 40, "a" * 300, "▁ marker ▁x", "é NFD", "​zero nb", "!!! ??? ... | --- ***"]


def parity(data: bytes, texts: list[str]) -> list[str]:
    """Those of the texts that the backend and the sentencepiece library encode or decode differently."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = tokenizer(data)
    return [t for t, e in zip(texts, ours.encode_batch(texts, add_special_tokens=False)) if e.ids != theirs.encode(t) or ours.decode(e.ids, skip_special_tokens=False) != theirs.decode(e.ids)]


class Codec:
    """Encodes whole batches; keeps what it has encoded."""

    def __init__(self, data: bytes, threads: int = THREADS):
        self.whole = tokenizer(data, threads)
        m = parse(data)
        cuts = self.whole.pre_tokenizer is not None and m.escape and not m.charsmap and not m.squeeze
        known = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.parting = known.get("<0x00>", -1)
        cuts = cuts and m.byte_fallback and self.parting >= 0 and not any(_PART in p for p, _, _ in m.pieces)
        self.part = build(m, prefix=False) if cuts else None
        self.prefix = " " if m.dummy_prefix else ""
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, dtype=np.uint64)
        self.at = self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def _learn(self, new: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        blob = data.tobytes()
        texts = [(self.prefix if f else "") + blob[a:b].decode("utf-8", "replace") for a, b, f in zip(start, end, first)]
        # many cuts go through the library as one text, parted by a character that its vocabulary has as a byte alone
        joined = [_PART.join(texts[k : k + 256]) for k in range(0, len(texts), 256)]
        ids = [e.ids for e in self.part.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.fromiter((y for x in ids for y in (*x, self.parting)), dtype=np.int32, count=sum(map(len, ids)) + len(ids))
        ends = np.flatnonzero(flat == self.parting)
        flat = flat[flat != self.parting]
        count = np.diff(np.append(-1, ends)) - 1
        at = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, flat])
        where = np.searchsorted(self.hash, new)
        self.hash, self.at, self.count = (np.insert(a, where, b) for a, b in ((self.hash, new), (self.at, at), (self.count, count)))

    def piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts, number of them a text)."""
        n, texts = len(data), len(offsets) - 1
        blank = data == 32
        edge = np.zeros(n, dtype=bool)
        edge[1:] = blank[1:] & ~blank[:-1]
        heads = np.unique(offsets[:-1][offsets[:-1] < n])
        edge[heads] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        first = np.zeros(n + 1, dtype=bool)
        first[heads] = True
        first = first[start]
        p, q = powers(n + 1)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=s[1:])
        h = mix((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64) + np.where(first, _FIRST, np.uint64(0)))
        if len(self.hash) > KEPT:
            self._forget()
        at = np.searchsorted(self.hash, h)
        unknown = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != h) if len(self.hash) else np.arange(len(h))
        if len(unknown):
            order = unknown[np.argsort(h[unknown], kind="stable")]
            lead = order[np.append(True, h[order][1:] != h[order][:-1])]
            self._learn(h[lead], data, start[lead], end[lead], first[lead])
            at = np.searchsorted(self.hash, h)
        if not len(h):
            return np.zeros(0, dtype=np.int32), np.zeros(texts, dtype=np.int64)
        count = self.count[at]
        total = np.cumsum(count)
        flat = self.pool[np.repeat(self.at[at] - (total - count), count) + np.arange(total[-1])]
        doc = np.searchsorted(offsets, start, side="right") - 1
        return flat, np.bincount(doc, weights=count, minlength=texts).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(lists of numbers, their lengths, round trips) of a column of texts; a null text is an empty one here."""
        flats, counts, goods = [], [], []
        for row, data, offsets in pieces(column):
            marked = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81) if len(data) > 2 else np.zeros(0, dtype=bool)
            blob = data.tobytes()
            texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            if self.part is not None and not marked.any() and (data != 0).all():
                flat, count = self.piece(data, offsets)
                ids = [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]
            else:
                ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
                count = np.array([len(x) for x in ids], dtype=np.int64)
                flat = np.fromiter((y for x in ids for y in x), dtype=np.int32, count=int(count.sum()))
            good = np.array([a == b for a, b in zip(self.whole.decode_batch(ids, skip_special_tokens=False), texts)], dtype=bool)
            flats.append(flat)
            counts.append(count)
            goods.append(good)
        if not flats:
            return pa.array([], type=pa.list_(pa.int32())), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        count = np.concatenate(counts)
        bounds = np.append(0, np.cumsum(count)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(flats))), count, np.concatenate(goods)


_CODECS: dict[str, Codec] = {}


class _Encode:
    """Adds pieces, their number and the round trip to batches of (others..., text)."""

    def __init__(self, data: bytes, threads: int):
        self.data, self.threads = data, threads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(self.data).hexdigest()
        codec = _CODECS.setdefault(key, None) or Codec(self.data, self.threads)
        _CODECS[key] = codec
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = part.column(part.num_columns - 1)
                void = text.is_null().to_numpy(zero_copy_only=False)
                ids, count, good = codec.encode(text)
                if void.any():
                    ids = pa.array([None if v else x for v, x in zip(void, ids.to_pylist())], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(np.where(void, -1, count)), pa.array(good, mask=void)], names=[*part.schema.names[:-1], "pieces", "n_pieces", "round_trip"])
        trim()


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """``id_col``, ``pieces`` (numbers), ``n_pieces`` and ``round_trip``: whether decoding gives the text again.

    The model file is read on the driver and travels with the tasks. Raises if the backend fails its parity check.
    """
    need(docs, id_col, text_col)
    with open(model_path, "rb") as f:
        data = f.read()
    if wrong := parity(data, PROBES):
        raise ValueError(f"the backend differs from the sentencepiece library on {wrong[:3]}")
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_Encode(data, threads), f"id {kind}, pieces array<int>, n_pieces bigint, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "pieces", "n_pieces", "round_trip")


class _Decode:
    def __init__(self, data: bytes, threads: int):
        self.data, self.threads = data, threads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(self.data, self.threads)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = tok.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts)], type=pa.string())], names=["id", "text"])


def sentencepiece_decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces", threads: int = THREADS) -> DataFrame:
    """``id_col`` and ``text``, decoded from lists of piece numbers; null gives null."""
    need(encoded, id_col, pieces_col)
    with open(model_path, "rb") as f:
        data = f.read()
    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[pieces_col].alias("pieces")).mapInArrow(_Decode(data, threads), f"id {kind}, text string")
    return out.select(F.col("id").alias(id_col), "text")
