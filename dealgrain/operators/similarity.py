"""Similarity joins of word sets, matching and clustering."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components

#: Words are counted by so many values of their hashes. Rows of postings that a part has, at most about; words of sets that are worked on at once; pairs that are; longs of the bits that stand for keys.
SLOTS, PART, SLICE, BLOCK, MARKS = 1 << 21, 2_500_000, 1_500_000, 500_000, 1 << 18
#: Words of the sets of a party that a task holds, at most about twice.
HELD = 12_000_000
SURE = 0.8


def _hashed(sets: DataFrame, key: str, words: str, group: str | None) -> DataFrame:
    """(k, node, words) of every set that isn't empty. Words are hashes of word and group; node is the same for equal sets of a group."""
    g = [F.col(group)] if group else []
    hashed = sets.select(F.col(key).alias("k"), F.sort_array(F.transform(F.col(words), lambda x: F.xxhash64(x, *g))).alias("words")).where(F.size("words") > 0)
    return hashed.withColumn("node", F.xxhash64("words", F.size("words")))


def _folded(sets: DataFrame, key: str, words: str, group: str | None, checkpoint: Callable) -> tuple[DataFrame, DataFrame]:
    """(k, node) of every set that isn't empty, and (node, words) once for equal sets of a group. Words are hashes of word and group."""
    base = checkpoint(_hashed(sets, key, words, group))
    return base.select("k", "node"), checkpoint(base.select("node", "words").dropDuplicates(["node"]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uses = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        word = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        uses += np.bincount(word & (SLOTS - 1), minlength=SLOTS)
    at = np.flatnonzero(uses)
    edges = np.searchsorted(at, np.arange(0, SLOTS + 1, SLOTS // 32))
    for k in np.flatnonzero(np.diff(edges)):
        mine = at[edges[k] : edges[k + 1]]
        yield _row(k, at=mine.astype(np.int32), uses=uses[mine])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uses = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for at, n in zip(batch.column(1), batch.column(2)):
            uses[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
    at = np.flatnonzero(uses)
    yield _row(int(uses.sum()), at=at.astype(np.int32), rank=np.floor(8 * np.log2(uses[at])).astype(np.uint8))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranks, total = np.zeros(SLOTS, dtype=np.uint8), 0
    for batch in batches:
        for n, at, rank in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            ranks[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(rank.as_buffer(), np.uint8)
            total += n
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([zlib.compress(ranks.tobytes(), 1)], pa.binary())], names=["total", "ranks"])


def _ranks(sets: DataFrame) -> tuple[bytes, int]:
    """How often the words of each slot are used, as 8 times the binary logarithm in a byte each, and how many words the sets have in all."""
    counted = sets.select("words").mapInArrow(_count, "k bigint, at binary, uses binary").repartition("k").mapInArrow(_summed, "k bigint, at binary, rank binary")
    got = counted.repartition(1).mapInArrow(_ranked, "total bigint, ranks binary").first()
    return (bytes(got.ranks), got.total) if got else (zlib.compress(bytes(SLOTS)), 0)


def _row(key: int, **arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays.values()]], names=["k", *arrays])


def _longs(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many longs the sketch of a set of ``n`` words has: a power of two, for about as many bits as words at high thresholds, more at lower ones."""
    times = 1 if threshold >= 0.7 else 4 if threshold >= 0.5 else 8
    return np.left_shift(1, np.clip(np.rint(np.log2(np.maximum(n, 1) * (times / 64))), 0, 10).astype(np.int64))


class _Postings:
    """(k, node, n, sketch, word, at, pos, root) of batches of (node, words) or (node, words, root), a row for each part of the words: the sets with words there, and these words.

    Only the words up to which a pair must share one come, from the rarest on by ``ranks`` and then by their hashes, and none that one set alone has.
    The sketch of a set has bits for the parity of the words that are hashed to it, so sketches differ in at most as many bits as sets differ in words.
    """

    def __init__(self, ranks: bytes, threshold: float, parts: int):
        self.ranks, self.threshold, self.parts = ranks, threshold, parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(zlib.decompress(self.ranks), np.uint8)
        for batch in batches:
            n = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                root = batch.column(2).slice(at, to - at).to_numpy() if batch.num_columns > 2 else None
                yield from self.told(batch.column(0).slice(at, to - at).to_numpy(), batch.column(1).slice(at, to - at).flatten().to_numpy(zero_copy_only=False), n[at:to], ranks, root)
                at = to

    def told(self, node: np.ndarray, word: np.ndarray, n: np.ndarray, ranks: np.ndarray, root: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(n)), n)
        longs = _longs(n, self.threshold)
        start = np.cumsum(longs) - longs
        bit = ((word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (64 * longs[row] - 1)
        parity = (np.bincount(64 * start[row] + bit, minlength=64 * int(longs.sum())) & 1).astype(np.uint8)
        sketch = np.packbits(parity, bitorder="little").view(np.uint64)
        rank = ranks[word & (SLOTS - 1)]
        order = np.lexsort((word, rank, row))
        word, row, rank = word[order], row[order], rank[order]
        pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        asked = n - np.ceil(n * self.threshold - 1e-9).astype(np.int64) + 1
        held = np.flatnonzero((pos < asked[row]) & (rank > 0))
        word, row, pos = word[held], row[held], pos[held]
        part = ((word.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % self.parts
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            mine = order[edges[p] : edges[p + 1]]
            sets, at = np.unique(row[mine], return_inverse=True)
            wide = longs[sets]
            bits = np.repeat(start[sets] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
            yield _row(p, node=node[sets], n=n[sets].astype(np.int32), sketch=sketch[bits], word=word[mine], at=at.astype(np.int32), pos=pos[mine].astype(np.int32), root=np.zeros(0, np.int64) if root is None else root[sets])


_TOLD = "k bigint, node binary, n binary, sketch binary, word binary, at binary, pos binary, root binary"


class _Meet:
    """(x, y), x < y, of rows of ``_Postings`` in order of k, the part: sets that share a word there and can be similar by sizes, places of the word and sketches.

    A part is held as arrays, and its pairs are looked at in blocks, so memory doesn't follow the number of pairs. A pair can come several times.
    """

    kinds = (np.int64, np.int32, np.uint64, np.int64, np.int32, np.int32, np.int64)

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for k, part in enumerate(batch.column(0).to_pylist()):
                if held and part != now:
                    yield from self.pairs(held)
                    held = []
                now = part
                held.append([np.frombuffer(batch.column(c + 1)[k].as_buffer(), kind).copy() for c, kind in enumerate(self.kinds)])
        if held:
            yield from self.pairs(held)

    def pairs(self, held: list) -> Iterator[pa.RecordBatch]:
        t = self.threshold
        base = np.cumsum([0] + [len(h[0]) for h in held])
        node, n, sketch, word, at, pos, root = (np.concatenate([h[c] for h in held]) for c in range(7))
        at = at + np.repeat(base[:-1], [len(h[4]) for h in held])
        held.clear()
        longs = _longs(n, t)
        start = np.cumsum(longs) - longs
        node, first, back = np.unique(node, return_index=True, return_inverse=True)  # copies of a set come from several batches
        at, n, longs, start = back[at], n[first].astype(np.int64), longs[first], start[first]
        root = root[first] if len(root) else None
        order = np.lexsort((at, n[at], word))
        word, at, pos = word[order], at[order], pos[order]
        new = np.append(True, (word[1:] != word[:-1]) | (at[1:] != at[:-1]))
        word, at, pos = word[new], at[new], pos[new]
        size = n[at]
        found, count = [], 0
        live, step = np.arange(len(word) - 1), 1
        while len(live):
            live = live[live + step < len(word)]
            live = live[(word[live + step] == word[live]) & (size[live] >= size[live + step] * t - 1e-9)]
            for lo in range(0, len(live), BLOCK):
                a = live[lo : lo + BLOCK]
                b = a + step
                both = size[a] + size[b]
                good = np.minimum(size[a] - pos[a], size[b] - pos[b]) >= np.ceil(both * (t / (1 + t)) - 1e-9)
                if root is not None:
                    good &= root[at[a]] != root[at[b]]
                x, y, most = at[a[good]], at[b[good]], np.floor(both[good] * ((1 - t) / (1 + t)) + 1e-9)
                near = self.alike(sketch, start, longs, x, y, most)
                if near.any():
                    found.append(np.minimum(x, y)[near] * len(node) + np.maximum(x, y)[near])
                    count += len(found[-1])
                    if count > 8 * BLOCK:
                        yield from self.out(found, node)
                        found, count = [], 0
            step += 1
        yield from self.out(found, node)

    def alike(self, sketch: np.ndarray, start: np.ndarray, longs: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs' sketches differ in at most ``most`` bits; the wider of two is folded to the other's width."""
        wide = np.minimum(longs[x], longs[y])
        near = np.zeros(len(x), dtype=bool)
        for w in np.unique(wide):
            these = np.flatnonzero(wide == w)
            for lo in range(0, len(these), max(1, BLOCK // int(w))):
                i = these[lo : lo + max(1, BLOCK // int(w))]
                apart = self.folded(sketch, start, longs, x[i], w) ^ self.folded(sketch, start, longs, y[i], w)
                near[i] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= most[i]
        return near

    @staticmethod
    def folded(sketch: np.ndarray, start: np.ndarray, longs: np.ndarray, x: np.ndarray, w: int) -> np.ndarray:
        out = sketch[start[x][:, None] + np.arange(w)]
        times = longs[x] // w
        k = 1
        while len(more := np.flatnonzero(times > k)):
            out[more] ^= sketch[start[x[more]][:, None] + k * w + np.arange(w)]
            k += 1
        return out

    @staticmethod
    def out(found: list, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if found:
            x, y = np.divmod(np.unique(np.concatenate(found)), len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["x", "y"])


class _Within:
    """(u, v) of rows (key, id, words) in order of key: links whose components within a key are those of its pairs with a Jaccard similarity of at least ``threshold``.

    The sets of a key are held as arrays and each is counted against all; pairs of sets that are linked already aren't passed on.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = np.append(np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)) if len(key) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and key[lo] != now:
                    yield self.links(held)
                    held = []
                now = key[lo]
                sets = batch.column(2).slice(lo, hi - lo)
                held.append((batch.column(1).slice(lo, hi - lo).to_numpy().copy(), np.diff(sets.offsets.to_numpy()).astype(np.int64), sets.flatten().to_numpy(zero_copy_only=False).copy()))
        if held:
            yield self.links(held)

    def links(self, held: list) -> pa.RecordBatch:
        node, n, word = (np.concatenate([h[c] for h in held]) for c in range(3))
        held.clear()
        _, word = np.unique(word, return_inverse=True)
        word = word.astype(np.int32)
        at = np.repeat(np.arange(len(n), dtype=np.int32), n)[np.argsort(word, kind="stable")]
        first, start = np.append(0, np.cumsum(np.bincount(word))), np.append(0, np.cumsum(n))
        label, u, v = np.arange(len(n)), [], []
        for x in range(len(n)):
            mine = word[start[x] : start[x + 1]]
            low, met = first[mine], first[mine + 1] - first[mine]
            shared = np.bincount(at[np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())], minlength=len(n))
            near = np.flatnonzero(shared / (n + n[x] - shared) >= self.threshold)
            near = near[label[near] != label[x]]
            if len(near):
                other, which = np.unique(label[near], return_index=True)
                u += [node[x]] * len(other)
                v += node[near[which]].tolist()
                label[np.isin(label, other)] = label[x]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _within(sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links of (key, id, words) within each key. A key of more than ``HELD`` words is cut into blocks, and each two of them meet in a task."""
    most = sets.groupBy("key").agg(F.sum(F.size("words")).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = -(-most // HELD)
    if blocks > 1:
        mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        two = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1).cast("int")), lambda c: F.struct(F.least(mine, c), F.greatest(mine, c)))
        sets = sets.select("key", "id", "words", F.explode(F.filter(two, lambda p: p["col1"] != p["col2"])).alias("two")).select(F.xxhash64("key", "two").alias("key"), "id", "words")
    return sets.repartition("key").sortWithinPartitions("key").mapInArrow(_Within(threshold), "u bigint, v bigint")


def party_links(files: DataFrame, near: float, with_party: float, checkpoint: Callable) -> DataFrame:
    """(node, root) of files (id, words, parties) that are tied by a Jaccard similarity of at least ``near``, or of at least ``with_party`` and a shared party.

    The second are found first, party by party, and near copies; sets that these tie don't meet again.
    """
    hashed = files.select(F.col("id").alias("k"), "parties", F.sort_array(F.transform("words", lambda x: F.xxhash64(x))).alias("words")).where(F.size("words") > 0)
    base = checkpoint(hashed.withColumn("node", F.xxhash64("words", F.size("words"))))
    first = checkpoint(base.groupBy("node").agg(F.min("k").alias("first")))
    ties = base.select("k", "node").join(first, "node").where("k <> first").select(F.col("first").alias("u"), F.col("k").alias("v"))
    named = base.select(F.explode(F.array_distinct("parties")).alias("party"), F.col("k").alias("id"), "words").where("party is not null").select(F.xxhash64("party").alias("key"), "id", "words")
    ends = lambda pairs: pairs.join(first.select(F.col("node").alias("x"), F.col("first").alias("u")), "x").join(first.select(F.col("node").alias("y"), F.col("first").alias("v")), "y")
    links = _within(named, with_party).unionByName(ties)
    if near < SURE:
        links = links.unionByName(ends(_near(base, SURE, checkpoint)).select("u", "v"))
    links = checkpoint(links)
    roots = connected_components(links, checkpoint).withColumnRenamed("node", "first")
    place = first.join(roots, "first", "left").select("node", F.coalesce("root", "first").alias("root"))
    apart = ends(_met(checkpoint(base.select("node", "words").join(place, "node")), near, checkpoint))
    close = _judged(apart.select("x", "y"), base, near).join(apart, ["x", "y"]).select("u", "v")
    return connected_components(links.unionByName(close), checkpoint)


class _Wholes(_Postings):
    """As ``_Postings``, but (k, node, n, sketch, sets, word, at, pos, first) with all words and the sets themselves in order of their words; the sketch is a long with a bit for each word."""

    def told(self, node: np.ndarray, word: np.ndarray, n: np.ndarray, ranks: np.ndarray, root: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(n)), n)
        rank = ranks[word & (SLOTS - 1)]
        order = np.lexsort((word, rank, row))
        word, row, rank = word[order], row[order], rank[order]
        start = np.cumsum(n) - n
        pos = np.arange(len(word)) - np.repeat(start, n)
        first = pos < (n - np.ceil(n * self.threshold - 1e-9).astype(np.int64) + 1)[row]
        sketch = np.bitwise_or.reduceat(np.uint64(1) << ((word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)), start) if len(word) else np.zeros(0, np.uint64)
        held = np.flatnonzero(rank > 0)
        part = ((word[held].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % self.parts
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            mine = held[order[edges[p] : edges[p + 1]]]
            sets, at = np.unique(row[mine], return_inverse=True)
            whole = word[np.repeat(start[sets] - np.cumsum(n[sets]) + n[sets], n[sets]) + np.arange(n[sets].sum())]
            yield _row(p, node=node[sets], n=n[sets].astype(np.int32), sketch=sketch[sets], sets=whole, word=word[mine], at=at.astype(np.int32), pos=pos[mine].astype(np.int32), first=first[mine].astype(np.int8))


_WHOLES = "k bigint, node binary, n binary, sketch binary, sets binary, word binary, at binary, pos binary, first binary"


class _Overlap(_Meet):
    """(x, y, similarity) of rows of ``_Wholes`` in order of k: pairs with an overlap coefficient of at least ``threshold``, each at the first word in x's order that they share."""

    kinds = (np.int64, np.int32, np.uint64, np.int64, np.int64, np.int32, np.int32, np.int8)

    def pairs(self, held: list) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0] + [len(h[0]) for h in held])
        node, n, sketch, sets, word, at, pos, first = (np.concatenate([h[c] for h in held]) for c in range(8))
        at = at + np.repeat(base[:-1], [len(h[5]) for h in held])
        held.clear()
        n = n.astype(np.int64)
        start = np.cumsum(n) - n
        _, sets = np.unique(sets, return_inverse=True)
        kinds = int(sets.max()) + 1
        known = np.sort(np.repeat(np.arange(len(n)), n) * kinds + sets)
        order = np.lexsort((node[at], n[at], word))
        word, at, pos, first = word[order], at[order], pos[order], first[order]
        live, step = np.flatnonzero(first), 1
        while len(live):
            live = live[live + step < len(word)]
            live = live[word[live + step] == word[live]]
            for lo in range(0, len(live), BLOCK):
                a = live[lo : lo + BLOCK]
                x, y, here = at[a], at[a + step], pos[a]
                need = np.ceil(n[x] * self.threshold - 1e-9).astype(np.int64)
                good = np.bitwise_count(sketch[x] & ~sketch[y]) <= n[x] - need
                x, y, here, need = x[good], y[good], here[good], need[good]
                rows = max(1, BLOCK * 8 // max(1, int(n[x].max(initial=1))))
                for k in range(0, len(x), rows):
                    yield from self.judged(x[k : k + rows], y[k : k + rows], here[k : k + rows], need[k : k + rows], node, n, start, sets, known, kinds)
            step += 1

    @staticmethod
    def judged(x, y, here, need, node, n, start, sets, known, kinds) -> Iterator[pa.RecordBatch]:
        m = n[x]
        begin = np.cumsum(m) - m
        asked = sets[np.repeat(start[x] - begin, m) + np.arange(m.sum())] + np.repeat(y, m) * kinds
        has = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        shared = np.add.reduceat(has.astype(np.int64), begin) if len(x) else np.zeros(0, np.int64)
        place = np.where(has, np.arange(len(has)) - np.repeat(begin, m), len(has))
        first = np.minimum.reduceat(place, begin) if len(x) else shared
        won = np.flatnonzero((shared >= need) & (first == here) & (x != y))
        if len(won):
            yield pa.RecordBatch.from_arrays([pa.array(node[x[won]]), pa.array(node[y[won]]), pa.array(shared[won] / n[x[won]])], names=["x", "y", "similarity"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(MARKS, dtype=np.int64)
    for batch in batches:
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([bits], pa.list_(pa.int64()))], names=["__bits"])


def likely(rows: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the only column of ``among``, and few others, before a join shuffles them: a table of bits of fixed size goes to all tasks."""
    place = lambda c: [f"cast(shiftrightunsigned({c}, {64 - MARKS.bit_length() + 1}) as int)", f"cast({c} & 63 as int)"]
    at, bit = place("h")
    marks = among.select(F.xxhash64(F.col(among.columns[0]).cast(rows.schema[key].dataType)).alias("h")).select(F.expr(at).alias("at"), F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    table = marks.repartition(1).mapInArrow(_marked, "__bits array<bigint>")
    at, bit = place("__h")
    return rows.withColumn("__h", F.xxhash64(key)).crossJoin(F.broadcast(table)).where(F.expr(f"getbit(__bits[{at}], {bit}) = 1")).select(*rows.columns)


def _met(sets: DataFrame, threshold: float, checkpoint: Callable) -> DataFrame:
    """(x, y): nodes x < y of (node, words) that can have a Jaccard similarity of at least ``threshold``; all that have, and few others at high thresholds.

    By prefix filtering: with all sets in one order of words, similar sets share one of their first ``n - ceil(threshold * n) + 1``
    words, and at the first word they share enough must be left behind it. Rare words come first in the order. The sets of a word meet in one
    task, which passes on pairs alone, of sets that sizes and sketches don't tell apart; only the sets of these pairs are shuffled. ``sets`` is read three times. With
    a ``root`` in ``sets`` only pairs of different roots come.
    """
    ranks, total = _ranks(sets)
    parts = max(min(24, 1 + total // 100_000), math.ceil(total * (1 - threshold) / PART))
    told = sets.select("node", "words", *[c for c in ("root",) if c in sets.columns]).mapInArrow(_Postings(ranks, threshold, parts), _TOLD)
    return checkpoint(told.repartition("k").sortWithinPartitions("k").mapInArrow(_Meet(threshold), "x bigint, y bigint").distinct())


def _near(sets: DataFrame, threshold: float, checkpoint: Callable) -> DataFrame:
    """(x, y, similarity) of nodes x < y of (node, words) with a Jaccard similarity of at least ``threshold``."""
    return _judged(_met(sets, threshold, checkpoint), sets, threshold)


def _judged(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity) of those pairs (x, y) of nodes that are similar."""
    asked = likely(sets.select("node", "words"), "node", met.select(F.explode(F.array("x", "y")))).dropDuplicates(["node"])
    full = met.join(asked.select(F.col("node").alias("x"), F.col("words").alias("wx")), "x").join(asked.select(F.col("node").alias("y"), F.col("words").alias("wy")), "y")
    shared = F.size(F.array_intersect("wx", "wy"))
    return full.select("x", "y", (shared / (F.size("wx") + F.size("wy") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(sets: DataFrame, threshold: float, key: str = "key", words: str = "words", group: str | None = None, checkpoint: Callable = lambda df: df) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with a Jaccard similarity of at least ``threshold``; of one ``group`` where given.

    Equal sets are one node of the join and are spread out afterwards. Words are told apart by 64 bits of a hash. Empty sets match
    nothing. ``checkpoint`` cuts the lineage of a DataFrame, so that sets are made once.
    """
    base = checkpoint(_hashed(sets, key, words, group))
    members, near = base.select("k", "node"), _near(base, threshold, checkpoint)
    one, other = (members.select(F.col("k").alias(k), F.col("node").alias(n)) for k, n in (("p", "x"), ("q", "y")))
    apart = near.join(one, "x").join(other, "y").select(*_ordered(), "similarity")
    same = one.join(other.withColumnRenamed("y", "x"), "x").where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(same)


def similar_links(sets: DataFrame, threshold: float, key: str = "key", words: str = "words", group: str | None = None, checkpoint: Callable = lambda df: df) -> DataFrame:
    """(u, v): links whose connected components are those of ``similar_pairs``, one for each further copy of a set, whatever the number of copies."""
    base = checkpoint(_hashed(sets, key, words, group))
    members = base.select("k", "node")
    first = members.groupBy("node").agg(F.min("k").alias("first"))
    ties = members.join(first, "node").where("k <> first").select(F.col("first").alias("u"), F.col("k").alias("v"))
    one, other = (first.select(F.col("first").alias(k), F.col("node").alias(n)) for k, n in (("u", "x"), ("v", "y")))
    return _near(base, threshold, checkpoint).join(one, "x").join(other, "y").select("u", "v").unionByName(ties)


def overlapping_pairs(sets: DataFrame, threshold: float, key: str, words: str, checkpoint: Callable = lambda df: df) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with an overlap coefficient (shared words over those of the smaller set) of at least ``threshold``.

    The smaller set of a pair must have one of its first ``n - ceil(threshold * n) + 1`` words in the other; frequent words come last. The sets of a word
    meet in one task, each with all its words, so pairs are judged there and only those that are alike leave it, once.
    """
    members, nodes = _folded(sets, key, words, None, checkpoint)
    ranks, total = _ranks(nodes)
    told = nodes.select("node", "words").mapInArrow(_Wholes(ranks, threshold, max(min(24, 1 + total // 100_000), math.ceil(total / PART))), _WHOLES)
    near = told.repartition("k").sortWithinPartitions("k").mapInArrow(_Overlap(threshold), "x bigint, y bigint, similarity double").where(F.col("similarity") >= threshold)
    one, other = (members.select(F.col("k").alias(k), F.col("node").alias(n)) for k, n in (("p", "x"), ("q", "y")))
    apart = near.join(one, "x").join(other, "y").select(*_ordered(), "similarity")
    same = one.join(other.withColumnRenamed("y", "x"), "x").where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("similarity"))
    return apart.unionByName(same)


def overlaps(sets: DataFrame, key: str, words: str) -> DataFrame:
    """(a, b, similarity): the overlap coefficient of all pairs a < b that share a word, which are as many as the result has rows.

    Shared words are counted by an equi-join that carries the sets' sizes and not the sets.
    """
    each = sets.select(F.col(key).alias("a"), F.size(words).alias("n"), F.explode(words).alias("word"))
    other = each.select(F.col("a").alias("b"), F.col("n").alias("m"), "word")
    met = each.join(other, "word").where("a < b").groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"))
    return met.select("a", "b", (F.col("shared") / F.least("n", "m")).alias("similarity"))


def _ordered() -> tuple[Column, Column]:
    p, q = F.col("p"), F.col("q")
    return F.when(p < q, p).otherwise(q).alias("a"), F.when(p < q, q).otherwise(p).alias("b")


def nearest(sets: DataFrame, key: str, words: str, steps: tuple[float, ...] = (0.8, 0.5, 0.2), checkpoint: Callable = lambda df: df) -> DataFrame:
    """(key, similarity): the highest Jaccard similarity of each set to another with which it shares a word; no row where it shares none.

    By falling thresholds: a set that has a neighbour at one has its nearest among those found there. Only sets without one are met by shared words at the end.
    """
    base = checkpoint(sets.select(F.col(key).alias("key"), F.col(words).alias("words")))
    found = None
    for t in steps:
        pairs = similar_pairs(base, t, checkpoint=checkpoint)
        ends = pairs.select(F.col("a").alias("key"), "similarity").unionByName(pairs.select(F.col("b").alias("key"), "similarity"))
        got = checkpoint(ends.groupBy("key").agg(F.max("similarity").alias("similarity")))
        new = got if found is None else got.join(found, "key", "left_anti")
        found = new if found is None else found.unionByName(new)
    each = base.select("key", F.size("words").alias("n"), F.explode("words").alias("word"))
    open_ = each.join(found, "key", "left_anti")
    other = each.select(F.col("key").alias("k2"), F.col("n").alias("m"), "word")
    met = open_.join(other, "word").where("key <> k2").groupBy("key", "n", "k2", "m").agg(F.count("*").alias("shared"))
    rest = met.groupBy("key").agg(F.max(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity"))
    return found.unionByName(rest).withColumnRenamed("key", key)


def best_match(items: DataFrame, references: DataFrame, item: str, reference: str, order: str, low: float = 0.0) -> DataFrame:
    """Each item's reference of the highest Jaccard similarity, the first in ``order`` on ties; none below ``low``.

    ``items`` has ``item`` and words, ``references`` have ``reference``, ``order`` and ref_words, both sets. Shared words are counted by an
    equi-join that carries the sets' sizes and not the sets; an item without a shared word has no match.
    """
    a = items.select(item, F.size("words").alias("n"), F.explode("words").alias("word"))
    b = references.select(reference, order, F.size("ref_words").alias("m"), F.explode("ref_words").alias("word"))
    pairs = a.join(b, "word").groupBy(item, reference, order, "n", "m").agg(F.count("*").alias("shared"))
    scored = pairs.withColumn("similarity", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).where(F.col("similarity") >= low)
    return scored.groupBy(item).agg(F.max_by(F.struct(reference, "similarity"), F.struct("similarity", -F.col(order))).alias("m")).select(item, f"m.{reference}", "m.similarity")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, left, right = None, set(), set()
    for batch in batches:
        won = []
        for k, (group, i, j) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
            if group != now:
                now, left, right = group, set(), set()
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                won.append(k)
        yield batch.take(pa.array(won, pa.int64())).select(range(1, 5))


def greedy_matching(edges: DataFrame, checkpoint: Callable) -> DataFrame:
    """One-to-one matching within each group, best edge first, of (group, i, j, similarity).

    Ties go to the smaller i, then j. The edges of a group pass through one task in this order, sorted there and spilled beyond its memory, and only
    the ends matched so far are held; so many equal clauses, all of them alike, take one pass as well.
    """
    rows = edges.select(F.xxhash64("group").alias("g"), "group", "i", "j", "similarity")
    ordered = rows.repartition("g").sortWithinPartitions("g", F.desc("similarity"), "i", "j")
    return checkpoint(ordered.mapInArrow(_greedy, edges.select("group", "i", "j", "similarity").schema))


def leaders(pairs: DataFrame, nodes: DataFrame, checkpoint: Callable) -> DataFrame:
    """Greedy leader clustering of (node), in node order, over similar pairs (a, b, similarity) with a < b: (node, leader, similarity).

    A node is a leader unless an earlier leader is similar; else it joins the most similar earlier leader, the first on ties. Rounds settle
    the nodes all of whose earlier neighbours are settled or that have a leader among them, so there are at most as many as nodes in the longest
    chain of similar ones in order; headings make short chains.
    """
    edges = checkpoint(pairs.select("a", "b", "similarity"))
    open_ = checkpoint(nodes.select("node").distinct())
    led = None
    while not open_.isEmpty():
        waiting = edges.join(open_.select(F.col("node").alias("a")), "a").join(open_.select(F.col("node").alias("b")), "b").select("b").distinct()
        new = checkpoint(open_.join(waiting.select(F.col("b").alias("node")), "node", "left_anti"))
        led = new if led is None else led.unionByName(new)
        covered = edges.join(new.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        open_ = checkpoint(open_.join(new, "node", "left_anti").join(covered, "node", "left_anti"))
    if led is None:
        return nodes.select("node", F.col("node").alias("leader"), F.lit(1.0).alias("similarity")).limit(0)
    led = checkpoint(led)
    follow = edges.join(led.select(F.col("node").alias("a")), "a").groupBy("b").agg(F.max("similarity").alias("similarity"), F.min_by("a", F.struct(-F.col("similarity"), "a")).alias("leader"))
    followers = follow.join(led.select(F.col("node").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), "leader", "similarity")
    return led.select("node", F.col("node").alias("leader"), F.lit(1.0).alias("similarity")).unionByName(followers)

