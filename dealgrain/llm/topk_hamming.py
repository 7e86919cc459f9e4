"""Exact top-k search over binary codes by incremental multi-index hashing.

An embedding's code is the signs of its numbers, 64 to a word. Every vector is a query; its ``k`` nearest others are
found by Hamming distance, of equal distances the smaller id. Codes are cut into segments of about log2(codes) bits, and each
segment is an index: codes sorted by its value. A query probes the values within r bits of its own, one segment after the other and then r + 1.
After segment a (of m, from 0) at radius r, every code within m * r + a bits has been verified, since any other differs by more
than r bits in a + 1 segments and by more than r - 1 in the rest. A query ends when its kth distance is at most that, or all codes have been verified.

Rows with equal codes are one query, asked for k + 1 neighbours, of which each row drops itself; and of a code the k + 1 smallest ids
are indexed, since no list can hold others. So copies cost nothing, however many there are.

Codes are dealt into blocks of ``BLOCK`` at most, each searched by one task at a time against one block of
queries, and a query's lists from the blocks are merged. So no table is broadcast, and a task holds one block, its order by each segment, and ``HITS``
pairs at a time whatever the data. The shuffle is rows times blocks. Dealing is by hash of the code, which spreads clusters.

A null id or embedding, an embedding with a null or NaN, and one of another length than ``dimensions`` where that is
given, give no row and are nobody's neighbour; where it is None each length is searched by itself, very long ones in as many segments as they need.
Equal codes are at distance 0 of each other; of rows that share an id the one
of the smallest length and then code counts. A table with fewer than k + 1 codes gives lists as long as it allows, an empty one no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, need

K = 10
NARROW, WIDE = 8, 22
BLOCK = 1 << 21
HITS = 1 << 20
ASKED = 2048
TASKS = 24


def sign_codes(numbers: np.ndarray) -> np.ndarray:
    """(rows, words): bit i is set when number i is above 0."""
    n, d = numbers.shape
    bits = np.zeros((n, -(-d // 64) * 64), dtype=np.uint8)
    bits[:, :d] = numbers > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def segment_bits(n: int, dimensions: int) -> int:
    """Bits of a segment: about log2(n), from ``NARROW`` to ``WIDE``, so that segments are equal but for the last."""
    near = min(max(NARROW, math.log2(max(n, 2))), WIDE)
    count = max(1, round(dimensions / near))
    while -(-dimensions // count) > WIDE:
        count += 1
    return -(-dimensions // count)


def segments(codes: np.ndarray, dimensions: int, width: int) -> np.ndarray:
    """(segments, rows): values of ``width`` bits each; the last may hold fewer bits."""
    out = np.zeros((-(-dimensions // width), len(codes)), dtype=np.int32)
    for k in range(len(out)):
        low, high = k * width, min((k + 1) * width, dimensions)
        word, at = divmod(low, 64)
        part = codes[:, word] >> np.uint64(at)
        if at and high > (word + 1) * 64:
            part = part | (codes[:, word + 1] << np.uint64(64 - at))
        out[k] = (part & np.uint64((1 << (high - low)) - 1)).astype(np.int32)
    return out


class Masks:
    """All values of some bits by how many are set; made once a process for each width."""

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, width: int, radius: int) -> np.ndarray:
        if width not in cls.held:
            ones = np.bitwise_count(np.arange(1 << width, dtype=np.uint32))
            cls.held[width] = (np.argsort(ones, kind="stable").astype(np.int32), np.append(0, np.cumsum(np.bincount(ones, minlength=width + 1))))
        order, bound = cls.held[width]
        return order[bound[radius] : bound[radius + 1]]


class Index:
    """Codes with their ids, and for each segment the order of their values."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, dimensions: int, width: int | None = None):
        self.codes, self.ids, self.dimensions = codes, ids, dimensions
        self.width = width or segment_bits(len(codes), dimensions)
        self.seg = segments(codes, dimensions, self.width)
        self.order = [np.argsort(s, kind="stable").astype(np.int32) for s in self.seg]
        self.bound = [np.append(0, np.cumsum(np.bincount(s, minlength=1 << self.width))).astype(np.int32) for s in self.seg]

    def _probe(self, segment: int, values: np.ndarray, radius: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, code rows) that agree in the segment but for exactly ``radius`` bits; in parts of about ``HITS``."""
        bound, order, masks = self.bound[segment], self.order[segment], Masks.of(self.width, radius)
        step = max(1, HITS // max(1, len(rows)))
        for at in range(0, len(masks), step):
            part = masks[at : at + step]
            want = (values[:, None] ^ part[None, :]).ravel()
            low = bound[want]
            count = bound[want + 1] - low
            held = np.flatnonzero(count)
            if not len(held):
                continue
            low, count = low[held].astype(np.int64), count[held].astype(np.int64)
            total = np.cumsum(count)
            cuts = np.unique(np.searchsorted(total, np.arange(HITS, total[-1] + HITS, HITS)))
            for a, b in zip(np.append(0, cuts[:-1] + 1), np.minimum(cuts + 1, len(total))):
                before = total[a] - count[a]
                yield np.repeat(rows[held[a:b] // len(part)], count[a:b]), order[np.repeat(low[a:b] - (total[a:b] - count[a:b] - before), count[a:b]) + np.arange(total[b - 1] - before)]

    def search(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(distances, ids) of each query's k nearest, padded with a distance of 1 << 30; the pairs verified, and the most at once."""
        n, far = len(codes), 1 << 30
        dist, near = np.full((n, k), far, dtype=np.int64), np.zeros((n, k), dtype=np.int64)
        seg = segments(codes, self.dimensions, self.width)
        open_, verified, most = np.arange(n), 0, 0
        for radius in range(self.width + 1):
            for s in range(len(seg)):
                for q, c in self._probe(s, seg[s][open_], radius, open_):
                    verified, most = verified + len(q), max(most, len(q))
                    d = np.bitwise_count(codes[q, 0] ^ self.codes[c, 0]).astype(np.int32)
                    for w in range(1, codes.shape[1]):
                        d += np.bitwise_count(codes[q, w] ^ self.codes[c, w])
                    # a pair is counted once: at its smallest segment distance, in the first segment that has it
                    hope = np.flatnonzero(d <= dist[q, -1])
                    q, c, d = q[hope], c[hope], d[hope]
                    better = (d < dist[q, -1]) | (self.ids[c] < near[q, -1])
                    q, c, d = q[better], c[better], d[better]
                    if not len(q):
                        continue
                    apart = np.bitwise_count(seg[:, q] ^ self.seg[:, c])
                    apart[s + 1 :] += 1
                    fresh = (apart[:s] > radius).all(axis=0) & (apart[s + 1 :] > radius).all(axis=0)
                    self._merge(dist, near, q[fresh], d[fresh].astype(np.int64), self.ids[c[fresh]], k)
                open_ = open_[dist[open_, -1] > len(seg) * radius + s]
                if not len(open_):
                    return dist, near, verified, most
        return dist, near, verified, most

    @staticmethod
    def _merge(dist: np.ndarray, near: np.ndarray, q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> None:
        if not len(q):
            return
        some = np.flatnonzero(np.bincount(q))
        q = np.concatenate([q, np.repeat(some, k)])
        d = np.concatenate([d, dist[some].ravel()])
        ids = np.concatenate([ids, near[some].ravel()])
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        dist[q[top], rank[top]] = d[top]
        near[q[top], rank[top]] = ids[top]


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """(rows, words) of binary codes of one length, without a copy for each."""
    held = column.combine_chunks()
    offsets = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(len(held), -1)


class _Search:
    def __init__(self, k: int, dimensions: int):
        self.k, self.dimensions = k, dimensions

    def __call__(self, queries: pa.Table, codes: pa.Table) -> pa.Table:
        names, lists = ["code", "distances", "neighbors"], pa.list_(pa.int64())
        if not queries.num_rows or not codes.num_rows:
            return pa.table([pa.array([], type=pa.binary()), pa.array([], type=lists), pa.array([], type=lists)], names=names)
        asked, index = _words(queries["code"]), Index(_words(codes["other_code"]), codes["other"].to_numpy(), self.dimensions)
        out = []
        for at in range(0, len(asked), ASKED):
            dist, near, _, _ = index.search(asked[at : at + ASKED], self.k)
            real = dist < 1 << 30
            bound = pa.array(np.append(0, np.cumsum(real.sum(axis=1))).astype(np.int32))
            out.append(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bound, pa.array(x[real])) for x in (dist, near)], names=names[1:]))
        found = pa.Table.from_batches(out)
        return pa.table([queries["code"].combine_chunks(), found["distances"].combine_chunks(), found["neighbors"].combine_chunks()], names=names)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for d in np.unique(length):
            part = batch.filter(pa.array(length == d))
            codes = sign_codes(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, d))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, d, dtype=np.int32)), pa.array([c.tobytes() for c in codes], type=pa.binary())], names=["id", "d", "code"])


def topk_hamming(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int | None = None, block: int = BLOCK, tasks: int = TASKS) -> DataFrame:
    """``id_col``, ``rank`` from 1, ``neighbor_id`` and ``distance``: k rows for each vector."""
    need(vectors, id_col, vector_col)
    v = vectors[vector_col]
    whole = vectors.where(vectors[id_col].isNotNull() & v.isNotNull()).select(vectors[id_col].cast("bigint").alias("id"), v.alias("v"))
    whole = whole.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    if dimensions is not None:
        whole = whole.where(F.size("v") == dimensions)
    coded = whole.mapInArrow(_codes, "id bigint, d int, code binary")
    coded = cut(coded.groupBy("id").agg(F.min(F.struct("d", "code")).alias("x")).select("id", "x.d", "x.code"))
    turn = F.row_number().over(Window.partitionBy("d", "code").orderBy("id"))
    first = cut(coded.withColumn("turn", turn).where(F.col("turn") <= k + 1))
    counts = {r.d: r["count"] for r in first.groupBy("d").count().collect()} or {dimensions or NARROW: 0}  # a row a length
    found = [_nearest(first.where(F.col("d") == d).select("id", "code", "turn"), n, d, k + 1, block, tasks).withColumn("d", F.lit(d)) for d, n in sorted(counts.items())]
    merged = coded.join(reduce(DataFrame.unionByName, found), ["d", "code"])
    others = F.slice(F.filter("top", lambda x: x["neighbors"] != F.col("id")), 1, k)
    return merged.select(F.col("id").alias(id_col), F.posexplode(others).alias("pos", "x")).select(id_col, (F.col("pos") + 1).alias("rank"), F.col("x.neighbors").alias("neighbor_id"), F.col("x.distances").cast("int").alias("distance"))


def _nearest(first: DataFrame, n: int, dimensions: int, k: int, block: int, tasks: int) -> DataFrame:
    """(code, top) for the distinct codes of n rows (id, code, turn) of one length."""
    blocks = max(1, -(-n // block))
    chunks = max(blocks, min(tasks, max(1, n // 64)))
    asked = first.where("turn = 1").select("code", F.pmod(F.xxhash64("code"), F.lit(chunks)).cast("int").alias("chunk")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = first.select(F.col("id").alias("other"), F.col("code").alias("other_code"), F.pmod(F.xxhash64("code", F.lit(7)), F.lit(blocks)).cast("int").alias("b"))
    held = held.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    search = _Search(k, dimensions)
    found = asked.groupBy("block", "chunk").cogroup(held.groupBy("b", "c")).applyInArrow(lambda queries, codes: search(queries, codes), "code binary, distances array<bigint>, neighbors array<bigint>")
    zipped = F.arrays_zip("distances", "neighbors")
    if blocks == 1:
        return found.select("code", zipped.alias("top"))
    each = found.select("code", F.explode(zipped).alias("x"))
    return each.groupBy("code").agg(F.slice(F.sort_array(F.collect_list(F.struct("x.distances", "x.neighbors"))), 1, k).alias("top"))  # k a block


def oracle(table: str = "embeddings", k: int = K) -> str:
    return f"""
WITH codes AS (SELECT vec_id, list_reduce(list_transform(range(len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS UBIGINT) << i ELSE CAST(0 AS UBIGINT) END), lambda a, b: a | b) AS code FROM {table}),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS distance FROM codes a JOIN codes b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= {k}"""
