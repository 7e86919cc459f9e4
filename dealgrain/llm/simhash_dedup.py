"""SimHash near-dedup with bit-sliced comparison.

A document's code has ``BITS`` bits: the majority, over its distinct words of at least four bytes (all words where there
are none), of each bit of their hashes. Documents with fewer than ``FEW`` such words get a random code of that set of
words, so codes match equal sets alone; texts without a word get one of their bytes. Two documents are near copies when
their codes differ in at most ``RADIUS`` bits, or in at most ``WIDE`` and the sets of their ``SHINGLE``-word shingles have a Jaccard
similarity of at least ``SIMILAR``. A text of fewer than ``FEW`` such words is compared with all of fewer than ``2 * FEW`` by an exact
join of the sets of all their words, near copies from ``SHORT`` on. Groups are the connected components of that relation.

Equal codes are one node. Candidates share one of several disjoint-by-turns samples (bands) of code bits; a bucket is
compared all against all: bit planes are stored vertically, 64 codes a word, the differences of 8 planes at a time go
through a carry-save adder into bitwise counters, and a block of codes is left as soon as every counter in it exceeds
the radius. A bucket passes on a spanning forest and not its pairs, so what follows is linear in the documents whatever
the groups' sizes. Pairs beyond the radius are passed on one by one where the forest doesn't tie them, and their texts compared
exactly; of a node the texts that differ are all compared. The number of bands and their width follow from ``EXPECTED``, the number of codes that buckets are
sized for, which is a parameter and not counted: a pair is found or not whatever else is in the table. A table beyond
it gives the same pairs with larger buckets; for a corpus of billions pass its size.

Null texts have no code and stay alone. Empty texts are equal to one another. Very long texts are hashed whole. Rows
with equal codes form a group, repeated rows and repeated ids included; a null doc_id comes before all others. An empty
table gives an empty result. Other columns are ignored, and kept as they are by ``keep_one``, whatever their names. Of a group the document with the smallest doc_id stays, of several with that id the one
whose text has the smallest hash; rows equal in both get the same result, and ``keep_one`` keeps one of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.similarity import similar_pairs
from .shared import cut, fresh, need
from .textvec import Runs, distinct, mix, pieces, trim, windows

BITS = 128
RADIUS = 22
WIDE = 30
SHINGLE, SIMILAR = 3, 0.5
BROADCAST = 200_000
FEW = 8
EXPECTED = 1 << 24
WIDTH, BUCKET = 10, 16384
SURE, RECALL = 0.99, 0.97
SHORT = 0.6
_NULL_ID = -(1 << 63)


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2) words of 64 code bits."""
    return _coded(data, offsets)[0]


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Runs]:
    """The codes, the number of words each was made of, and all words."""
    n = len(offsets) - 1
    runs = Runs(data, offsets)
    long = runs.end - runs.start >= 4
    some = np.bincount(runs.doc[long], minlength=n) > 0
    used = long | ~some[runs.doc]
    doc = runs.doc[used].astype(np.uint64)
    # a row number of 20 bits and a hash of 44 sort as one key; pieces hold fewer rows than that
    key = distinct((doc << np.uint64(44)) | (runs.hash[used] >> np.uint64(20)))
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    word = mix(key << np.uint64(20))
    count = np.diff(first)
    out = np.zeros((n, BITS // 64), dtype=np.uint64)
    total = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(word, out=total[1:])
    whole = mix((total[first[1:]] - total[first[:-1]]) ^ count.astype(np.uint64))
    for row in np.flatnonzero(count == 0):
        whole[row] = np.uint64(int.from_bytes(hashlib.blake2b(data[offsets[row] : offsets[row + 1]].tobytes(), digest_size=8).digest(), "little"))
    for k in range(BITS // 64):
        seed = np.uint64((0x51ED270B9F1D5A3B * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        out[:, k] = mix(whole ^ seed)
        many = np.flatnonzero(count >= FEW)
        if len(many):
            bits = np.unpackbits(mix(word ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = np.concatenate([bits, np.zeros((1, bits.shape[1]), dtype=np.uint8)])  # where the last texts have no word
            ones = np.add.reduceat(bits, first[:-1], axis=0, dtype=np.int32)[many]
            out[many, k] = np.packbits(2 * ones > count[many, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out, count, runs


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in pieces(batch.column(2)):
            n = len(offsets) - 1
            text = batch.column(2).slice(row, n)
            c, count, runs = _coded(data, offsets)
            c = c.view(np.int64)
            void = text.is_null().to_numpy(zero_copy_only=False)
            sets = [distinct(runs.hash[runs.first[k] : runs.first[k + 1]]).view(np.int64) for k in np.flatnonzero((count > 0) & (count < 2 * FEW))]
            size = np.zeros(n + 1, dtype=np.int32)
            size[1:][(count > 0) & (count < 2 * FEW)] = [len(x) for x in sets]
            words = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, n) for k in (0, 1)), pa.array(c[:, 0], mask=void), pa.array(c[:, 1], mask=void), pa.array(count < FEW), words], names=["id", "t", "c0", "c1", "few", "words"])
    trim()


def planes(c: np.ndarray) -> np.ndarray:
    """Bit planes of some codes: plane p has bit p of every code, 64 codes a word."""
    bits = np.unpackbits(c.view(np.uint8).reshape(len(c), -1), axis=1, bitorder="little")
    held = np.packbits(bits.T, axis=1, bitorder="little")
    wide = np.zeros((BITS, -(-len(c) // 64) * 8), dtype=np.uint8)
    wide[:, : held.shape[1]] = held
    return wide.view(np.uint64)


def _add(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _at_least(bits: list[np.ndarray], least: int) -> np.ndarray:
    """Where the number of these bits, lowest first, is at least ``least``."""
    if least >= 1 << len(bits):
        return np.zeros_like(bits[0])
    more, same = np.zeros_like(bits[0]), np.full_like(bits[0], ~np.uint64(0))
    for k in range(len(bits) - 1, -1, -1):
        if least >> k & 1:
            same = same & bits[k]
        else:
            more |= same & bits[k]
            same = same & ~bits[k]
    return more | same


def within(vertical: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, code) numbers of all pairs at most ``radius`` bits apart; padding lanes are codes of zeros."""
    ask = np.unpackbits(queries.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    masks = np.where(ask, ~np.uint64(0), np.uint64(0)).T[:, :, None]
    rows = np.arange(len(queries))
    zero = np.zeros((len(rows), vertical.shape[1]), dtype=np.uint64)
    ones, twos, fours, high = zero, zero, zero, [zero] * (BITS.bit_length() - 3)
    for p in range(0, BITS, 8):
        x = [vertical[k][None, :] ^ masks[k] for k in range(p, p + 8)]
        ones, a = _add(ones, x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, f = _add(twos, a, b)
        ones, a = _add(ones, x[4], x[5])
        ones, b = _add(ones, x[6], x[7])
        twos, g = _add(twos, a, b)
        fours, carry = _add(fours, f, g)
        for k in range(len(high)):
            high[k], carry = high[k] ^ carry, high[k] & carry
        if p >= radius and p + 8 < BITS:
            alive = (~_at_least(high, radius // 8 + 1)).any(axis=1)
            left = int(alive.sum())
            if not left:
                return rows[:0], rows[:0]
            if left * 2 < len(rows):
                rows, masks = rows[alive], masks[:, alive]
                ones, twos, fours, high = ones[alive], twos[alive], fours[alive], [h[alive] for h in high]
    hit = ~_at_least([ones, twos, fours, *high], radius + 1)
    r, w = np.nonzero(hit)
    bits = np.unpackbits(hit[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(bits)
    return rows[r[k]], w[k] * 64 + lane


def _pairs(c: np.ndarray, radius: int, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, later code) numbers of all pairs at most ``radius`` bits apart, in parts."""
    n = len(c)
    vertical = planes(c)
    step = max(1, min(tile, (1 << 22) // max(n, 1)))
    for at in range(0, n, step):
        head = at // 64
        q, other = within(vertical[:, head:], c[at : at + step], radius)
        q, other = q + at, other + head * 64
        real = (other < n) & (other > q)
        yield q[real], other[real]


def _tie(root: np.ndarray, q: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``root`` with these pairs in one component."""
    while len(q):
        low = np.minimum(root[q], root[other])
        before = root.copy()
        for side in (root[q], root[other], q, other):
            np.minimum.at(root, side, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    return root


def forest(c: np.ndarray, radius: int = RADIUS, tile: int = 256) -> np.ndarray:
    """For each code the first one of its component in this block."""
    root = np.arange(len(c))
    for q, other in _pairs(c, radius, tile):
        root = _tie(root, q, other)
    return root


def plan(expected: int = EXPECTED, radius: int = RADIUS, wide: int = WIDE) -> tuple[int, int]:
    """(bits of a band, bands) for tables of about ``expected`` codes: buckets of at most ``BUCKET`` on average, and a share of
    ``SURE`` of the pairs at ``radius`` bits and ``RECALL`` of those at ``wide`` in a common bucket."""
    width = max(WIDTH, math.ceil(math.log2(max(expected, 1) / BUCKET)))
    need = lambda recall, bits: math.ceil(math.log(1 - recall) / math.log(1 - (1 - bits / BITS) ** width))
    return width, max(need(SURE, radius), need(RECALL, wide))


def band_bits(width: int, bands: int) -> np.ndarray:
    """Which code bits each band takes: a shuffle of all bits is dealt out, and another when it is used up."""
    rng = np.random.default_rng(20)
    dealt: list[int] = []
    out = []
    for _ in range(bands):
        if len(dealt) < width:
            dealt = [int(x) for x in rng.permutation(BITS)]
        out.append([dealt.pop() for _ in range(width)])
    return np.array(out)


class _Bands:
    def __init__(self, width: int, bands: int):
        self.bits = band_bits(width, bands)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, c0, c1 = (batch.column(k).to_numpy() for k in range(3))
            held = (c0.view(np.uint64), c1.view(np.uint64))
            for k, bits in enumerate(self.bits):
                key = np.zeros(len(node), dtype=np.uint64)
                for at, b in enumerate(bits):
                    key |= ((held[b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(at)
                key |= np.uint64(k) << np.uint64(len(bits))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1), batch.column(2)], names=["bucket", "node", "c0", "c1"])


class _Compare:
    """Links of the buckets of rows sorted by bucket: sure ones, and pairs up to ``wide`` bits apart to be confirmed."""

    def __init__(self, radius: int, wide: int):
        self.radius, self.wide = radius, wide

    def _links(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, node, c0, c1 = (table.column(k).to_numpy() for k in range(4))
        turns = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        c = np.stack([c0, c1], axis=1).view(np.uint64)
        us, vs, sure = [], [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sure)], names=["u", "v", "sure"])
            for x in (us, vs, sure):
                x.clear()
            return out

        def add(u: np.ndarray, v: np.ndarray, known: bool) -> None:
            us.append(u)
            vs.append(v)
            sure.append(np.full(len(u), known))

        for a, b in zip(turns[:-1], turns[1:]):
            if b - a < 2:
                continue
            block, own = np.ascontiguousarray(c[a:b]), node[a:b]
            root = np.arange(b - a)
            for q, other in _pairs(block, max(self.radius, self.wide)):
                near = np.bitwise_count(block[q] ^ block[other]).sum(axis=1) <= self.radius
                root = _tie(root, q[near], other[near])
                apart = ~near & (root[q] != root[other])
                if apart.any():
                    add(np.minimum(own[q[apart]], own[other[apart]]), np.maximum(own[q[apart]], own[other[apart]]), False)
                    if sum(map(len, us)) > 1 << 18:
                        yield batch()
            tied = np.flatnonzero(root != np.arange(b - a))
            if len(tied):
                add(own[tied], own[root[tied]], True)
        if us:
            yield batch()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            open_at = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if open_at:
                yield from self._links(pa.Table.from_batches([*kept, batch.slice(0, open_at)]))
                kept = [batch.slice(open_at)]
            elif kept and kept[-1].column(0)[0].as_py() != int(bucket[0]):
                yield from self._links(pa.Table.from_batches(kept))
                kept = [batch]
            else:
                kept.append(batch)
        if kept:
            yield from self._links(pa.Table.from_batches(kept))
        trim()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, the distinct shingles of the text) of (t, text)."""
    for batch in batches:
        for row, data, offsets in pieces(batch.column(1)):
            runs = Runs(data, offsets)
            sets = [distinct(windows(runs.hash[a:b], SHINGLE)).view(np.int64) for a, b in zip(runs.first[:-1], runs.first[1:])]
            bounds = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets)))], names=["t", "shingles"])
    trim()


def _confirmed(source: DataFrame, coded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes (u, v) that have texts whose shingle sets are similar.

    Up to ``BROADCAST`` hashes of the texts asked for, counted first, go to the scan of the texts; beyond that the join shuffles.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked = cut(coded.where("c0 is not null").select(F.xxhash64("c0", "c1").alias("node"), "t").join(ends, "node").distinct())
    wanted = asked.select("t").distinct()
    if asked.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    sets = cut(source.where("t is not null").select("t", "text").join(wanted, "t").mapInArrow(_shingles, "t bigint, shingles array<bigint>").dropDuplicates(["t"]))
    side = lambda end, t: asked.select(F.col("node").alias(end), F.col("t").alias(t))
    held = lambda t, s: sets.select(F.col("t").alias(t), F.col("shingles").alias(s))
    both = pairs.join(side("u", "tu"), "u").join(side("v", "tv"), "v").join(held("tu", "su"), "tu").join(held("tv", "sv"), "tv")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.where((shared > 0) & (shared >= F.lit(SIMILAR) * (F.size("su") + F.size("sv") - shared))).select("u", "v")


def _short(coded: DataFrame) -> DataFrame:
    """(u, v): the nodes of two similar short texts, one of few words at least; each set of words of a node is compared."""
    sets = cut(coded.where(F.size("words") > 0).groupBy(F.xxhash64("c0", "c1").alias("node"), "words").agg(F.max("few").alias("few")).withColumn("key", F.xxhash64("node", "words")))
    if sets.where("few").isEmpty():
        return sets.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    near = similar_pairs(sets, SHORT, checkpoint=cut)
    side = lambda key, end: sets.select(F.col("key").alias(key), F.col("node").alias(end), F.col("few").alias(f"few_{end}"))
    return cut(near.join(side("a", "u"), "a").join(side("b", "v"), "b").where("(few_u or few_v) and u <> v").select("u", "v"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, wide: int = WIDE, expected: int = EXPECTED) -> DataFrame:
    """(id, t, group, lead): one row for each row of ``docs``. id and group are BIGINT with the least value for a null id,
    t is a hash of the text, null for a null text, and lead tells whether (id, t) is the smallest of its group."""
    need(docs, id_col, text_col)
    text = docs[text_col]
    source = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NULL_ID)).alias("id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("t"), text.alias("text"))
    coded = cut(source.mapInArrow(_encode, "id bigint, t bigint, c0 bigint, c1 bigint, few boolean, words array<bigint>"))
    nodes = cut(coded.where("c0 is not null").groupBy("c0", "c1").agg(F.min(F.struct("id", "t")).alias("least")).withColumn("node", F.xxhash64("c0", "c1")))
    width, bands = plan(expected, radius, wide)
    spread = nodes.select("node", "c0", "c1").mapInArrow(_Bands(width, bands), "bucket bigint, node bigint, c0 bigint, c1 bigint")
    compared = cut(spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_Compare(radius, wide), "u bigint, v bigint, sure boolean").distinct())
    links = compared.where("sure").select("u", "v").unionByName(_short(coded))
    tied = connected_components(links, cut)
    root = lambda end: tied.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    apart = compared.where("not sure").join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    apart = cut(apart.select("u", "v"))
    if not apart.isEmpty():
        tied = connected_components(links.unionByName(_confirmed(source, coded, apart)), cut)
    roots = nodes.join(tied, "node", "left").select("c0", "c1", "least", F.coalesce("root", "node").alias("root"))
    first = roots.groupBy("root").agg(F.min("least").alias("first"))
    held = coded.drop("few", "words").join(roots.join(first, "root").select("c0", "c1", "first"), ["c0", "c1"], "left")
    return held.select("id", "t", F.coalesce("first.id", "id").alias("group"), (F.col("first").isNull() | (F.struct("id", "t") == F.col("first"))).alias("lead"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, expected: int = EXPECTED) -> DataFrame:
    """``id_col``, ``group_id`` (the smallest id of its near copies, its own if it has none) and ``keep``, for each row."""
    back = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return groups(docs, id_col, text_col, radius, expected=expected).select(back("id").alias(id_col), back("group").alias("group_id"), F.col("lead").alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, expected: int = EXPECTED) -> DataFrame:
    """``docs`` with one row of each group of near copies; rows with a null text all stay. Columns are as they were."""
    found = cut(groups(docs, id_col, text_col, radius, expected=expected))
    key, t, gone = fresh(docs, "id"), fresh(docs, "t"), fresh(docs, "gone")
    keyed = docs.withColumns({key: F.coalesce(docs[id_col].cast("bigint"), F.lit(_NULL_ID)), t: F.when(docs[text_col].isNotNull(), F.xxhash64(docs[text_col]))})
    drop = found.where("not lead").select(F.col("id").alias(key), F.col("t").alias(t), F.lit(True).alias(gone)).distinct()
    left = keyed.join(drop, [key, t], "left").where(F.col(gone).isNull())
    if found.where("lead and t is not null").groupBy("id", "t").count().where("count > 1").limit(1).count():
        voids = left.where(F.col(t).isNull())
        left = left.where(F.col(t).isNotNull()).dropDuplicates([key, t]).unionByName(voids)
    return left.select(*docs.columns)
