"""Passages of at least ``WORDS`` words that other documents repeat, by column-wise suffix sorting.

Words are compared without case and marks. Every passage of ``WORDS`` words holds a run of ``GRAM`` words whose hash is the smallest of the passage
(winnowing), so both copies of a passage select the same run, and the runs that only one document selects are dropped after
one shuffle of hashes. What is left are *contexts*: the words from which any such passage around the run must
come, ``WORDS - GRAM`` before it and ``WORDS`` from its beginning. Where all contexts of a run are equal they are the
repeat. Else the run's distinct contexts, each fetched from one document that has it, are strings of a collection of several runs.

A collection's suffixes are sorted column by column, from the right: each round inserts one symbol of every string. The
Burrows-Wheeler transform so far, the common prefixes and the suffixes' names are sequential files in the shared folder, and
so are the columns of symbols. A round reads transform and prefixes front to back in blocks: the symbols' counts so far give each new suffix its
place, and the least prefix since a symbol's last occurrence gives the common prefix with the suffix before it and of the one
after it. A second pass merges old and new into the next round's files. Memory holds the place of each string, counters for each symbol and
a block. Neighbours with a common prefix of ``WORDS`` from different documents are repeats; they go back to all
documents with those contexts by a join on run and context.

Collections hold whole runs, about ``BATCH`` strings each. Contexts are a few dozen words, so a document costs in
proportion to its length and is never cut; a run in very many documents is streamed, and costs its distinct contexts.

A document is a row; rows equal in doc_id and text are one document. Repeats within one document alone don't count. Null, empty and
short texts have none, very long texts are searched whole. A document without a repeat gives no row. Bounds are word numbers from 0, ends not included; passages that overlap or
touch are merged. A null doc_id is kept as null. Words are told apart by 32 bits of a hash within, and 64 bits around, a run. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, need, removed, shared_dir
from .textvec import Runs, mix, pieces, powers, trim, windows

WORDS = 50
GRAM = 35
BATCH = 1 << 16
BLOCK = 1 << 18
HELD = 1 << 18
_BACK = WORDS - GRAM
_SPAN = WORDS + _BACK


def _sliding(v: np.ndarray, width: int, best) -> np.ndarray:
    """best over v[i : i + width], for each i at which it fits."""
    done, out = 1, v
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number in all texts, hash) of the selected runs; ``first`` has where each text's words begin."""
    none = np.zeros(0, dtype=np.int64)
    if len(word) < WORDS:
        return none, none, none.astype(np.uint64)
    count = np.diff(first)
    gram = windows(word, GRAM) | np.uint64(1)
    wide = WORDS - GRAM + 1
    least = _sliding(gram, wide, np.minimum)
    at = np.arange(len(least))
    doc = np.searchsorted(first, at, side="right") - 1
    least = np.where(at + WORDS <= first[doc + 1], least, np.uint64(0))  # windows within one text
    del count
    pad = np.zeros(wide - 1, dtype=np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), wide, np.maximum)
    chosen = np.flatnonzero(gram == most)
    return np.searchsorted(first, chosen, side="right") - 1, chosen, gram[chosen]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, row, at, context, back, size) of batches of (row, text)."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for row, data, offsets in pieces(batch.column(1)):
            runs = Runs(data, offsets)
            doc, at, gram = anchors(runs.first, runs.hash)
            if not len(at):
                continue
            low = np.maximum(at - _BACK, runs.first[doc])
            high = np.minimum(at + WORDS, runs.first[doc + 1])
            p, q = powers(len(runs.hash) + 1)
            s = np.zeros(len(runs.hash) + 1, dtype=np.uint64)
            np.cumsum(runs.hash * p[: len(runs.hash)], out=s[1:])
            context = mix((s[high] - s[low]) * q[low] + (high - low).astype(np.uint64) * np.uint64(64) + (at - low).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(rows[row + doc]), pa.array((at - runs.first[doc]).astype(np.int32)), pa.array(context.view(np.int64)), pa.array((at - low).astype(np.int8)), pa.array((high - low).astype(np.int8))],
                names=["run", "row", "at", "context", "back", "size"],
            )


def _by_run(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole runs, of rows sorted by run, about a batch each. With ``most``, a run of more rows of several documents is
    passed on in parts, each a table of its own but for the last."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column(0).to_numpy()
        cut_at = int(np.searchsorted(run, run[-1]))
        if cut_at == 0 and kept and kept[-1].column(0)[0].as_py() == int(run[0]):
            kept.append(batch)
        else:
            if kept or cut_at:
                yield pa.Table.from_batches([*kept, batch.slice(0, cut_at)])
            kept = [batch.slice(cut_at)]
        if most and sum(b.num_rows for b in kept) > most:
            table = pa.Table.from_batches(kept)
            row = table.column(1).to_numpy()
            if row.min() != row.max():
                yield table
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by run, those whose run several rows have; ``sure`` where all contexts of the run are equal.

    A run that comes in parts is never sure: its contexts are compared as any others.
    """
    hot = None
    for table in _by_run(batches, HELD):
        run, row, _, context, _, size = (table.column(k).to_numpy() for k in range(6))
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        long = np.diff(np.append(head, len(run)))
        many = np.minimum.reduceat(row, head) != np.maximum.reduceat(row, head)
        same = np.minimum.reduceat(context, head) == np.maximum.reduceat(context, head)
        if table.num_rows > HELD and len(head) == 1 and many[0]:
            hot = run[0]
        if hot is not None:
            many |= run[head] == hot
            same &= run[head] != hot
        keep, sure = np.repeat(many, long), np.repeat(same, long)
        keep &= size >= WORDS
        yield from table.append_column("sure", pa.array(sure)).filter(pa.array(keep)).combine_chunks().to_batches()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, context, low, high, back, words) of batches of (text, array of (run, context, low, high, at, back, size)); words are 32 bits each."""
    for batch in batches:
        wanted = batch.column(1)
        for row, data, offsets in pieces(batch.column(0)):
            n = len(offsets) - 1
            runs = Runs(data, offsets)
            word = (runs.hash >> np.uint64(32)).astype(np.uint32)
            part = wanted.slice(row, n)
            flat = part.flatten()
            doc = np.repeat(np.arange(n), np.diff(part.offsets.to_numpy()))
            run, context, low, high, at, back, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(7))
            sizes = size.astype(np.int64)
            total = np.cumsum(sizes)
            if not len(total):
                continue
            index = np.repeat(runs.first[doc] + at - back - (total - sizes), sizes) + np.arange(total[-1])
            words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, total * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(word[index]))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (run, context, low, high, back)), words], names=["run", "context", "low", "high", "back", "words"])


class _RangeMin:
    """Minima over ranges of an array, by blocks of 32."""

    def __init__(self, x: np.ndarray):
        self.x = np.concatenate([x, np.full(-len(x) % 32, 255, dtype=x.dtype)])
        blocks = self.x.reshape(-1, 32)
        self.left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min of x[low..high], both included, low <= high."""
        a, b = low >> 5, high >> 5
        out = np.minimum(self.right[low], self.left[high])
        near = np.flatnonzero(a == b)
        if len(near):
            lane = np.arange(32)
            rows = self.x.reshape(-1, 32)[a[near]].copy()
            rows[(lane < (low[near] & 31)[:, None]) | (lane > (high[near] & 31)[:, None])] = 255
            out[near] = rows.min(axis=1)
        far = np.flatnonzero(b - a > 1)
        if len(far):
            lo, hi = a[far] + 1, b[far] - 1
            level = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
            for k in np.unique(level):
                j = np.flatnonzero(level == k)
                t = self.table[k]
                out[far[j]] = np.minimum(out[far[j]], np.minimum(t[lo[j]], t[hi[j] - (1 << int(k)) + 1]))
        return out


class Files:
    """Sequential files in a folder of its own below ``folder``, a URI that all executors reach; gone at the end."""

    def __init__(self, folder: str):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.root = f"{root}/{uuid.uuid4().hex}"

    def __enter__(self) -> Files:
        self.fs.create_dir(self.root)
        return self

    def __exit__(self, *_) -> None:
        self.fs.delete_dir(self.root)

    def writer(self, name: str) -> pa.NativeFile:
        return self.fs.open_output_stream(f"{self.root}/{name}")

    def put(self, name: str, x: np.ndarray) -> None:
        with self.writer(name) as f:
            f.write(np.ascontiguousarray(x))

    def reader(self, name: str, kind: type) -> Reader:
        return Reader(self.fs.open_input_stream(f"{self.root}/{name}"), np.dtype(kind))

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete_file(f"{self.root}/{name}")


class Reader:
    def __init__(self, stream: pa.NativeFile, kind: np.dtype):
        self.stream, self.kind = stream, kind

    def take(self, n: int) -> np.ndarray:
        """The next n numbers, fewer at the end of the file."""
        parts, left = [], n * self.kind.itemsize
        while left and (data := self.stream.read(left)):
            parts.append(data)
            left -= len(data)
        return np.frombuffer(b"".join(parts), dtype=self.kind)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()


class _Symbols:
    """What one pass over transform and prefixes carries from block to block for each symbol."""

    def __init__(self, size: int):
        self.seen = np.zeros(size, dtype=np.int64)
        self.new_last = np.zeros(size, dtype=bool)  # whether its last occurrence precedes a suffix that is new
        self.low = np.full(size, 255, dtype=np.uint8)  # the least common prefix after its last occurrence

    def move_on(self, t: np.ndarray, p: np.ndarray, new: np.ndarray) -> None:
        last = np.full(len(self.seen), -1, dtype=np.int64)
        last[t] = np.arange(len(t))
        here = last >= 0
        tail = np.append(np.minimum.accumulate(p[::-1])[::-1], np.uint8(255))
        self.low = np.where(here, tail[last + 1], np.minimum(self.low, p.min()))
        self.new_last = np.where(here, new[last], self.new_last)
        self.seen += np.bincount(t, minlength=len(self.seen))


def _places(files: Files, turn: int, place: np.ndarray, symbol: np.ndarray, below: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """(rank, common prefix) of each new suffix, and (rank, common prefix) of the old ones after new ones, by rank.

    ``place`` has, in order, where ``symbol`` goes into the transform, and ``below`` how many symbols of it are smaller than each.
    """
    state = _Symbols(len(below))
    rank, prefix = np.empty(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.uint8)
    later: list[tuple[np.ndarray, np.ndarray]] = []
    start = done = 0
    with files.reader(f"transform-{turn}", np.uint32) as ts, files.reader(f"prefix-{turn}", np.uint8) as ps:
        while len(t := ts.take(block)):
            p = ps.take(block)
            to = int(np.searchsorted(place, start + len(t)))
            here = place[done:to] - start
            t = t.copy()
            t[here] = symbol[done:to]
            number = np.full(len(t), -1, dtype=np.int64)
            number[here] = np.arange(done, to)
            asked = state.new_last.copy()
            asked[symbol[done:to]] = True
            i = np.flatnonzero(asked[t])
            s = t[i]
            order = np.argsort(s.astype(np.uint16) if len(below) <= 1 << 16 else s, kind="stable")
            i, s = i[order], s[order]
            if len(i):
                head = np.append(True, s[1:] != s[:-1])
                first = np.flatnonzero(head)
                position = below[s] + state.seen[s] + np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                new = number[i] >= 0
                before = np.append(False, new[:-1])
                before[first] = state.new_last[s[first]]
                touched = (new | before) & (s != 0)
                value = np.zeros(len(i), dtype=np.uint8)
                inner = np.flatnonzero(touched & ~head)
                if len(inner):
                    value[inner] = 1 + _RangeMin(p)(i[inner - 1] + 1, i[inner])
                outer = first[touched[first] & (state.seen[s[first]] > 0)]
                value[outer] = 1 + np.minimum(state.low[s[outer]], np.minimum.accumulate(p)[i[outer]])
                mine = number[i[new]]
                rank[mine], prefix[mine] = position[new], value[new]
                old = touched & ~new
                later.append((position[old], value[old]))
            state.move_on(t, p, number >= 0)
            start, done = start + len(t), to
    at, value = (np.concatenate(x) for x in zip(*later)) if later else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
    order = np.argsort(at)
    return rank, prefix, at[order], value[order]


def _merge(files: Files, turn: int, place: np.ndarray, symbol: np.ndarray, rank: np.ndarray, prefix: np.ndarray, name: np.ndarray, at: np.ndarray, value: np.ndarray, old: int, block: int) -> None:
    """The next round's files: the ``old`` suffixes and the new ones, which ``rank`` has in order."""
    m, read = len(place), 0

    def transform(n: int) -> np.ndarray:
        nonlocal read
        a, b = np.searchsorted(place, [read, read + n])
        t = ts.take(n).copy()
        t[place[a:b] - read] = symbol[a:b]
        read += n
        return t

    with files.reader(f"transform-{turn}", np.uint32) as ts, files.reader(f"prefix-{turn}", np.uint8) as ps, files.reader(f"name-{turn}", np.int32) as ns, files.writer(f"transform-{turn + 1}") as to, files.writer(f"prefix-{turn + 1}") as po, files.writer(f"name-{turn + 1}") as no:
        to.write(transform(m))  # the empty suffixes
        po.write(ps.take(m))
        for begin in range(0, old + m, block):
            size = min(block, old + m - begin)
            a, b = np.searchsorted(rank, [begin, begin + size])
            kept = np.ones(size, dtype=bool)
            kept[rank[a:b] - begin] = False
            t, p, n = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.int32)
            held = size - (b - a)
            t[kept], p[kept], n[kept] = transform(held), ps.take(held), ns.take(held)
            p[~kept], n[~kept] = prefix[a:b], name[a:b]
            c, d = np.searchsorted(at, [begin, begin + size])
            p[at[c:d] - begin] = value[c:d]
            for f, x in ((to, t), (po, p), (no, n)):
                f.write(x)
    files.drop(f"transform-{turn}", f"prefix-{turn}", f"name-{turn}")


def collection_suffixes(symbols: np.ndarray, files: Files, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffixes in order as string * columns + offset, common prefix of each with the one before it).

    ``symbols`` has a string a row; 0 pads strings at either end and equals nothing, itself included.
    """
    m, columns = symbols.shape
    size = int(symbols.max(initial=0)) + 1
    for column in range(columns):
        files.put(f"column-{column}", symbols[:, column].astype(np.uint32))
    del symbols
    for name, kind in (("transform", np.uint32), ("prefix", np.uint8)):
        files.put(f"{name}-0", np.zeros(m, dtype=kind))  # of the empty suffixes, in the strings' order
    files.put("name-0", np.zeros(0, dtype=np.int32))
    place, string, count = np.arange(m), np.arange(m), np.zeros(size, dtype=np.int64)
    for turn in range(columns):
        column = columns - 1 - turn
        with files.reader(f"column-{column}", np.uint32) as f:
            symbol = f.take(m)[string]
        files.drop(f"column-{column}")
        count += np.bincount(symbol, minlength=size)
        rank, prefix, at, value = _places(files, turn, place, symbol, np.cumsum(count) - count, block)
        order = np.argsort(rank)
        rank, prefix, following = rank[order], prefix[order], string[order]
        _merge(files, turn, place, symbol, rank, prefix, (following * columns + column).astype(np.int32), at, value, turn * m, block)
        place, string = rank + m, following
    with files.reader(f"prefix-{columns}", np.uint8) as ps, files.reader(f"name-{columns}", np.int32) as ns:
        ps.take(m)
        while len(n := ns.take(block)):
            yield n, ps.take(block)


def _alike(suffixes: Iterator[tuple[np.ndarray, np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, whether it begins a group) of the suffixes that have a neighbour with ``words`` words in common, in order."""
    names, heads, last = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=bool)], None
    for name, prefix in suffixes:
        if last is not None:
            name, prefix = np.append(last[0], name), np.append(last[1], prefix)
        long = prefix >= words
        keep = long[:-1] | long[1:]  # the last waits for what follows
        names.append(name[:-1][keep])
        heads.append(~long[:-1][keep])
        last = name[-1:], prefix[-1:]
    if last is not None and last[1][0] >= words:
        names.append(last[0])
        heads.append(np.zeros(1, dtype=bool))
    return np.concatenate(names), np.concatenate(heads)


def repeats(contexts: list[bytes], back: np.ndarray, low: np.ndarray, high: np.ndarray, files: Files, words: int = WORDS, columns: int = _SPAN, before: int = _BACK, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset from its first word) of each passage of ``words`` words that several rows have; ``low`` and ``high`` are the least and the largest row of each context."""
    m = len(contexts)
    size = np.array([len(c) // 4 for c in contexts], dtype=np.int64)
    start = before - np.asarray(back, dtype=np.int64)
    names, dense = np.unique(np.frombuffer(b"".join(contexts), dtype=np.uint32), return_inverse=True)
    symbols = np.zeros((m, columns), dtype=np.uint32)
    lane = np.arange(columns)
    symbols[(lane >= start[:, None]) & (lane < (start + size)[:, None])] = dense + 1
    del names, dense
    # a context that several rows have is a repeat without a neighbour
    own = np.flatnonzero(low != high)
    turns = size[own] - words + 1
    own, alone = np.repeat(own, turns), np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns)
    suffix, head = _alike(collection_suffixes(symbols, files, block), words)
    if not len(suffix):
        return own, alone
    string, group = suffix // columns, np.flatnonzero(head)
    many = np.minimum.reduceat(low[string], group) != np.maximum.reduceat(high[string], group)
    inside = np.repeat(many, np.diff(np.append(group, len(suffix))))
    return np.append(own, string[inside]), np.append(alone, (suffix % columns - start[string])[inside])


class _Sort:
    """(run, context, start, end) of the repeats in contexts sorted by run; bounds from the context's first word."""

    def __init__(self, folder: str):
        self.folder = folder

    def _solve(self, tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        run, context, low, high, back = (t.column(k).to_numpy() for k in range(5))
        with Files(self.folder) as files:
            which, offset = repeats(t.column(5).to_pylist(), back, low, high, files)
        m = _merged(which, offset, offset + WORDS)
        which = m.column(0).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(run[which]), pa.array(context[which]), m.column(1), m.column(2)], names=["run", "context", "start", "end"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for table in _by_run(batches):
            held.append(table)
            if sum(t.num_rows for t in held) >= BATCH:
                yield self._solve(held)
                held = []
        if held:
            yield self._solve(held)
        trim()


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if len(row):
        # running maximum of the ends within a row: rows are set apart by an offset larger than any end
        base = np.cumsum(np.append(0, row[1:] != row[:-1])) * (int(end.max()) + 2)
        reach = np.maximum.accumulate(end + base)
        head = np.flatnonzero(np.append(True, start[1:] + base[1:] > reach[:-1]))
        row, start, end = row[head], start[head], reach[np.append(head[1:], len(order)) - 1] - base[head]
    return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(start), pa.array(end)], names=["row", "start", "end"])


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, at, back, size = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
        yield _merged(row, at - back, at - back + size)


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, spans) of (id, array of (start, end)): the spans merged."""
    for batch in batches:
        part = batch.column(1)
        flat = part.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(part.offsets.to_numpy()))
        m = _merged(doc, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False))
        bounds = np.searchsorted(m.column(0).to_numpy(), np.arange(batch.num_rows + 1)).astype(np.int32)
        start, end = (pa.array(m.column(k).to_numpy().astype(np.int32)) for k in (1, 2))
        words = np.add.reduceat(np.append(m.column(2).to_numpy() - m.column(1).to_numpy(), 0), bounds[:-1]) if batch.num_rows else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([start, end], names=["start", "end"])), pa.array(words)], names=["id", "spans", "n_words"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans`` (array of start and end in words) and ``repeated_words``, for documents with repeats."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    source = docs.where(docs[text_col].isNotNull()).select(F.xxhash64(docs[id_col], docs[text_col]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = source.select("row", "text").mapInArrow(_anchor_rows, "run bigint, row bigint, at int, context bigint, back tinyint, size tinyint")
    shared = cut(found.repartition("run").sortWithinPartitions("run").mapInArrow(_shared, "run bigint, row bigint, at int, context bigint, back tinyint, size tinyint, sure boolean"))
    sure = shared.where("sure").select("row", "at", "back", "size").mapInArrow(_sure, "row bigint, start bigint, end bigint")
    unsure = shared.where("not sure").select("run", "context", "row", "at", "back", "size")
    # one document stands for all that have a context, so that each context is fetched and sorted once
    kinds = unsure.groupBy("run", "context", "back", "size").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min_by("at", "row").alias("at"))
    wanted = kinds.groupBy(F.col("low").alias("row")).agg(F.collect_list(F.struct("run", "context", "low", "high", "at", "back", "size")).alias("wanted"))
    fetched = source.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(_contexts, "run bigint, context bigint, low bigint, high bigint, back tinyint, words binary")
    folder = f"{shared_dir(spark).rstrip('/')}/suffixes-{uuid.uuid4().hex}"
    hits = cut(fetched.repartition("run").sortWithinPartitions("run").mapInArrow(_Sort(folder), "run bigint, context bigint, start bigint, end bigint"))
    removed(spark, folder)
    back = unsure.join(hits, ["run", "context"]).select("row", (F.col("at") - F.col("back") + F.col("start")).alias("start"), (F.col("at") - F.col("back") + F.col("end")).alias("end"))
    spans = sure.unionByName(back).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    ids = source.select("row", "id").dropDuplicates(["row"])
    merged = ids.join(spans, "row").select("id", "spans").mapInArrow(_join_up, f"id {kind}, spans array<struct<start:int,end:int>>, n_words bigint")
    return merged.select(F.col("id").alias(id_col), "spans", F.col("n_words").alias("repeated_words"))
