"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A feature is the hash, into ``1 << BITS`` buckets, of one word or mark of the text or of two that follow each other; case
counts. A pair of the same word twice is one feature whatever the word. A document has each of its features once.
Training goes over a sample of labelled documents, one at a time, with per-coordinate FTRL-proximal updates (L1 and L2);
a document is bad when its label has quality 0 or toxic 1. Scoring is a sparse dot product: the weights, of fixed size,
go to the workers once, and a scan of the texts sums the weights of each document's features.

The sample has at most ``SAMPLE`` labelled documents (of those in the table, the ones of the smallest hashes of doc_id), a
documented bound on the training cost alone; every document is scored. The features of the sample are computed where its documents are read, and
only their bucket numbers reach the one task that trains, in an order fixed by the hash, so training is repeatable.

Null and empty texts have no feature and are scored by the bias alone. Very long texts are scored whole. An empty table gives no row. Labels that are null count as good; labels of one
doc_id are merged, bad winning; labels without a document are ignored, as are those with a null doc_id. With no label at all every
document gets 0.5 and is kept. Rows that share a doc_id are scored one by one. Other columns are ignored or, by ``keep_good``, returned as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, need, unit
from .textvec import Runs, distinct, mix, pieces, sums, trim

BITS = 20
SAMPLE = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.1
THRESHOLD = 0.5
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SAME = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, distinct and ascending for each text, and where each text's begin."""
    runs = Runs(data, offsets, fold=False, marks=True)
    h, doc = runs.hash, runs.doc
    near = np.flatnonzero(doc[1:] == doc[:-1]) if len(h) else np.zeros(0, dtype=np.int64)
    pair = mix(h[near] * _PAIR + h[near + 1])
    pair[h[near] == h[near + 1]] = _SAME
    low = np.uint64((1 << BITS) - 1)
    key = np.concatenate([(doc.astype(np.uint64) << np.uint64(BITS)) | (h & low), (doc[near].astype(np.uint64) << np.uint64(BITS)) | (pair & low)])
    key = distinct(key)
    first = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
    return (key & low).astype(np.int64), first


def ftrl(index: np.ndarray, first: np.ndarray, bad: np.ndarray, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """The weights of documents whose features are ``index[first[i]:first[i + 1]]``, taken in order; the last weight is the bias, which isn't regularised."""
    size = 1 << bits
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    for _ in range(epochs):
        for k in range(len(bad)):
            x = index[first[k] : first[k + 1]]
            zx, nx = z[x], n[x]
            root, bias_root = np.sqrt(nx), math.sqrt(bias_n)
            w = -np.sign(zx) * np.maximum(np.abs(zx) - L1, 0) / ((BETA + root) / ALPHA + L2)
            bias = -bias_z / ((BETA + bias_root) / ALPHA + L2)
            g = 1 / (1 + math.exp(-min(35.0, max(-35.0, w.sum() + bias)))) - bad[k]
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(n[x]) - root) / ALPHA * w
            bias_n += g * g
            bias_z += g - (math.sqrt(bias_n) - bias_root) / ALPHA * bias
    out = np.empty(size + 1, dtype=np.float32)
    out[:-1] = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    out[-1] = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA + L2)
    return out


def score(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The probability of being bad, for each text."""
    out = np.zeros(len(column))
    for row, data, offsets in pieces(column):
        index, first = features(data, offsets)
        out[row : row + len(offsets) - 1] = sums(weights[index].astype(np.float64), first)
    return 1 / (1 + np.exp(-np.clip(out + float(weights[-1]), -35, 35)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[np.ndarray] = []
        for _, data, offsets in pieces(batch.column(2)):
            index, first = features(data, offsets)
            rows += [index[first[k] : first[k + 1]] for k in range(len(offsets) - 1)]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype(np.int32) for r in rows], type=kind)], names=["turn", "bad", "x"])


def _train(table: pa.Table) -> pa.Table:
    """(turn, bad, x) of the sample to (at, weight), the nonzero weights; features stay in the buffer in which they came."""
    x = table["x"].combine_chunks()
    bounds, flat = x.offsets.to_numpy(), x.values.to_numpy()
    order = np.lexsort((np.diff(bounds), table["turn"].to_numpy()))
    size = np.diff(bounds)[order]
    first = np.append(0, np.cumsum(size))
    index = flat[np.repeat(bounds[:-1][order] - first[:-1], size) + np.arange(first[-1])]
    weights = ftrl(index, first, table["bad"].to_numpy()[order])
    held = np.flatnonzero(weights)
    kinds = [pa.list_(pa.int32()), pa.list_(pa.float32())]
    out = pa.table([pa.array([v], type=k) for v, k in zip((held.astype(np.int32), weights[held]), kinds)], names=["at", "weight"])
    del x, flat, index, table
    trim()
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The weights, fitted on at most ``sample`` of the labelled documents."""
    need(docs, id_col, text_col)
    need(labels, "doc_id", "quality", "toxic")
    bad = (F.coalesce(labels["quality"], F.lit(1)) == 0) | (F.coalesce(labels["toxic"], F.lit(0)) == 1)
    label = labels.where(labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("bigint").alias("id"), bad.cast("double").alias("bad"))
    label = label.groupBy("id").agg(F.max("bad").alias("bad")).withColumn("turn", unit(F.col("id")))
    text = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    # labels of other documents take no place in the sample: a scan of ids alone finds those that are here
    label = cut(text.select("id").join(label, "id").distinct())
    # the share that is needed is cut by hash, which leaves a few more than the sample; the rest go by rank
    n = label.count()
    share = 1.0 if n <= sample else min(1.0, 1.1 * sample / n + 200 / n)
    chosen = label.where(F.col("turn") <= share).orderBy("turn", "id").limit(sample)
    rows = text.join(F.broadcast(chosen), "id").select("turn", "bad", "text")  # at most ``sample`` rows of 24 bytes
    fitted = rows.mapInArrow(_sampled, "turn double, bad double, x array<int>").groupBy().applyInArrow(_train, "at array<int>, weight array<float>").collect()
    weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
    for row in fitted:
        weights[np.array(row["at"], dtype=np.int64)] = row["weight"]
    return weights


class _Score:
    """Scores batches; carries the nonzero weights, which each worker spreads out once."""

    def __init__(self, weights: np.ndarray, text: int):
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.weight, self.text = weights[self.at], text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
        weights[self.at] = self.weight
        for batch in batches:
            others = [k for k in range(batch.num_columns) if k != self.text]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(score(batch.column(self.text), weights))], names=[*(batch.schema.names[k] for k in others), "p_bad"])
        trim()


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``p_bad`` rounded to 6 places and ``keep``, for each document."""
    weights = train(docs, labels, id_col, text_col, sample)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_Score(weights, 1), f"id {kind}, p_bad double")
    return scored.select(F.col("id").alias(id_col), F.round("p_bad", 6).alias("p_bad"), (F.col("p_bad") < threshold).alias("keep"))


class _Keep:
    """Passes on the rows of documents below the threshold."""

    def __init__(self, weights: np.ndarray, text: int, threshold: float):
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.weight, self.text, self.threshold = weights[self.at], text, threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
        weights[self.at] = self.weight
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(self.text), weights) < self.threshold))
        trim()


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns, in one scan."""
    weights = train(docs, labels, id_col, text_col, sample)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return docs.mapInArrow(_Keep(weights, at, threshold), docs.schema)
