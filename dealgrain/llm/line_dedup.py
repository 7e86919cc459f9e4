"""Line dedup: one sort of line hashes, and keep bitmaps instead of text.

Each document's lines are hashed where the document is read, with a position for each. Hashes are range-partitioned and
sorted by (hash, document, position) within a partition, so equal lines lie next to each other and one streaming pass
keeps the first occurrence. Before that shuffle every batch drops its own later occurrences, which bounds what a line
that is in every document sends to one partition by the number of batches. Only the positions to drop travel back,
grouped by document; texts never do.

A line is what a line feed separates, compared without the blanks, tabs and carriage returns around it. Blank lines are
always kept and never compared. Of equal lines the one with the smallest (doc_id, position) stays; a null doc_id comes
before all others. The bitmap is compressed as run lengths joined by commas, of kept and dropped lines in turn,
beginning with kept ("0" first if the first line goes). Null text has no line: n_lines 0 and an empty bitmap; an empty
text has one blank line. Rows equal in doc_id and text count as one
and give one row; rows that share only the doc_id give a row each, the order between them being that of a text hash.
Very long texts are hashed and cut whole, in time proportional to their length. An empty table gives no row. Other columns are
ignored, and kept as they are by ``without_dropped``, whatever their names.
Hashes have 64 bits; two different lines of n get the same one with probability about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, need
from .textvec import mix, pieces, powers, trim

_NULL_ID = -(1 << 63)

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 13, 32]] = True


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each text, then document, hash, start and end of each line); blank lines have hash 0."""
    n = len(data)
    feeds = np.flatnonzero(data == 10)
    fed = np.searchsorted(feeds, offsets)
    count = np.diff(fed) + 1
    first = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(count, out=first[1:])
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(first[-1]) - first[doc]
    feeds = np.append(feeds, n)
    last = at == count[doc] - 1
    end = np.where(last, offsets[doc + 1], feeds[np.minimum(fed[doc] + at, len(feeds) - 1)])
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[first[:-1]] = offsets[:-1]
    solid = np.flatnonzero(~_BLANK[data])
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end)
    blank = a == b
    solid = np.append(solid, n)
    left = np.where(blank, start, solid[a])
    right = np.where(blank, start, solid[b - 1] + 1)
    p, q = powers(n + 1)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=s[1:])
    h = mix((s[right] - s[left]) * q[left] + (right - left).astype(np.uint64))
    h[blank] = 0
    return first, doc, h, start, end


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # nulls are filled before NumPy sees them: a BIGINT column with a null would become floats
        ids, first_row = pc.fill_null(batch.column(0).cast(pa.int64()), _NULL_ID).to_numpy(), batch.column(2).to_numpy()
        valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, ...]] = []
        for row, data, offsets in pieces(batch.column(1)):
            first, doc, h, _, _ = line_table(data, offsets)
            held = valid[row + doc] & (h != 0)
            at = np.arange(len(h)) - first[doc]
            out.append((h[held].view(np.int64), ids[row + doc[held]], first_row[row + doc[held]], at[held]))
        h, d, r, at = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), (), ())))
        if not len(h):
            continue
        order = np.lexsort((at, r, d, h))
        h, d, r, at = h[order], d[order], r[order], at[order]
        again = np.append(False, (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (r[1:] == r[:-1]) & (at[1:] == at[:-1]))
        h, d, r, at = h[~again], d[~again], r[~again], at[~again]
        new = np.append(True, h[1:] != h[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, d, r, at.astype(np.int64))] + [pa.array(~new)], names=["hash", "doc", "row", "at", "dropped"])
    trim()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document and position, those that aren't the first of their hash."""
    last, head = None, (0, 0, 0)
    for batch in batches:
        h, d, r, at = (batch.column(k).to_numpy() for k in range(4))
        if not len(h):
            continue
        first = np.append(last is None or h[0] != last, h[1:] != h[:-1])
        # a row equal to the first of its hash in every column is the same row read twice
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
        same = [np.where(lead >= 0, x[np.maximum(lead, 0)], y) == x for x, y in zip((d, r, at), head)]
        late = ~(same[0] & same[1] & same[2])
        if lead[-1] >= 0:
            head = (d[lead[-1]], r[lead[-1]], at[lead[-1]])
        last = h[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[late]) for x in (d, r, at)], names=["doc", "row", "at"])


def _rle(dropped: np.ndarray, n: int) -> str:
    if not n:
        return ""
    keep = np.ones(n, dtype=bool)
    keep[dropped] = False
    turns = np.flatnonzero(keep[1:] != keep[:-1]) + 1
    runs = np.diff(np.concatenate([[0], turns, [n]]))
    return ("" if keep[0] else "0,") + ",".join(map(str, runs))


def _bitmaps(dropped: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_rle(np.asarray(d, dtype=np.int64), int(k)) for d, k in zip(dropped, n)], dtype=object)


def bits(bitmap: str | None) -> np.ndarray:
    """The run lengths as booleans, true for a line that stays."""
    runs = np.array([int(x) for x in (bitmap or "").split(",") if x], dtype=np.int64)
    return np.repeat(np.arange(len(runs)) % 2 == 0, runs)


def _cut_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of these numbers; null where no line is left."""
    out = []
    for row, data, offsets in pieces(text):
        n = len(offsets) - 1
        part = gone.slice(row, n)
        first, doc, _, start, end = line_table(data, offsets)
        keep = np.ones(len(doc), dtype=bool)
        lost = np.diff(pc.fill_null(pc.list_value_length(part), 0).to_numpy().cumsum(), prepend=0)
        keep[first[np.repeat(np.arange(n), lost)] + part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = False
        fed = np.append(start[1:], len(data)) - start  # a line and the feed after it
        byte = np.repeat(keep, fed)
        held = np.flatnonzero(keep)
        last = held[np.append(doc[held][1:] != doc[held][:-1], True)] if len(held) else held
        byte[end[last][fed[last] > end[last] - start[last]]] = False  # no feed after the last line that stays
        left = np.append(0, np.cumsum(byte))[offsets].astype(np.int32)
        none = np.ones(n, dtype=bool)
        none[doc[held]] = False
        valid = pa.array(~none).buffers()[1]
        out.append(pa.Array.from_buffers(pa.string(), n, [valid, pa.py_buffer(left), pa.py_buffer(data[byte])]))
    return pa.concat_arrays(out) if out else pa.array([], type=pa.string())


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, at) of every line that repeats an earlier one. doc is the least BIGINT for a null id; row is a hash of the text."""
    need(docs, id_col, text_col)
    source = docs.select(docs[id_col].cast("bigint").alias("doc"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("row"))
    hashed = cut(source.mapInArrow(_hash_lines, "hash bigint, doc bigint, row bigint, at bigint, dropped boolean"))
    late = hashed.where("dropped").select("doc", "row", "at")
    heads = hashed.where("not dropped").select("hash", "doc", "row", "at").repartitionByRange("hash").sortWithinPartitions("hash", "doc", "row", "at")
    return late.unionByName(heads.mapInArrow(_later, "doc bigint, row bigint, at bigint"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``n_lines``, ``n_kept`` and ``keep_bitmap``."""
    bitmaps = F.pandas_udf(_bitmaps, "string")
    late = dropped_lines(docs, id_col, text_col).groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))
    text = docs[text_col]
    every = docs.select(
        F.coalesce(docs[id_col].cast("bigint"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text).alias("row"), docs[id_col].alias("held"),
        F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
    ).dropDuplicates(["doc", "row"])
    both = every.join(late, ["doc", "row"], "left")
    return both.select(
        F.col("held").alias(id_col), "n_lines", (F.col("n_lines") - F.coalesce(F.size("gone"), F.lit(0))).cast("bigint").alias("n_kept"),
        F.when(F.col("n_lines") == 0, "").when(F.col("gone").isNull(), F.col("n_lines").cast("string")).otherwise(bitmaps(F.coalesce("gone", F.array().cast("array<bigint>")), "n_lines")).alias("keep_bitmap"),
    )


def without_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut from ``text_col``; a document of which no line is left goes. Null texts stay.

    Only texts that lose lines go to Python, as Arrow batches; other columns stay as they are.
    """
    late = dropped_lines(docs, id_col, text_col).groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))
    doc, row, gone = (fresh(docs, x) for x in ("doc", "row", "gone"))
    late = late.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("gone").alias(gone))
    keyed = docs.withColumns({doc: F.coalesce(docs[id_col].cast("bigint"), F.lit(_NULL_ID)), row: F.xxhash64(docs[text_col])})
    both = keyed.join(late, [doc, row], "left")
    kept = F.col(gone)
    cut_text = F.arrow_udf(_cut_lines, "string").asNondeterministic()  # or the filter below would cut every text a second time
    left = fresh(docs, "left")
    changed = both.withColumn(left, cut_text(F.when(kept.isNotNull(), F.col(text_col)), kept)).where(kept.isNull() | F.col(left).isNotNull())
    return changed.withColumn(text_col, F.when(kept.isNull(), F.col(text_col)).otherwise(F.col(left))).select(*docs.columns)


def oracle(table: str = "documents") -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM {table} WHERE text IS NOT NULL),
ranked AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) = '' OR
    row_number() OVER (PARTITION BY trim(line, ' ' || chr(9) || chr(13)) ORDER BY doc_id NULLS FIRST, pos) = 1 AS kept
  FROM lines),
turns AS (
  SELECT *, CASE WHEN kept = lag(kept) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM ranked),
islands AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM turns),
runs AS (SELECT doc_id, island, bool_and(kept) AS kept, count(*) AS n FROM islands GROUP BY doc_id, island)
SELECT d.doc_id, coalesce(CAST(sum(n) AS BIGINT), 0) AS n_lines, coalesce(CAST(sum(CASE WHEN kept THEN n END) AS BIGINT), 0) AS n_kept,
  coalesce(CASE WHEN bool_or(island = 1 AND NOT kept) THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY island), '') AS keep_bitmap
FROM {table} d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
