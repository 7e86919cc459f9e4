"""Sharding along a Hilbert curve, so that files hold boxes of several metadata dimensions.

Each dimension is quantised to ``BITS`` bits in an order-preserving way: names by the share of rows that come before
them in alphabetical order, lengths by the position of the highest bit and the two bits after it. The levels' index on a
Hilbert curve comes from a table of curve states, one step a bit, in built-in expressions. Documents are sorted by index,
then doc_id, and the sorted run is cut into shards of ``SHARD_CHARS`` characters, so that the minimum and maximum of
every dimension in a shard's file footers prune it.

The order is one range partitioning; partitions' totals (one row a partition) are added up, and running sums stay inside
partitions, of documents and of names. Tables of names are counted before they are broadcast; larger ones are joined by salted keys.

A null name is "" and comes first; a null or negative length counts as 0. A null doc_id comes first among equals. Rows that
repeat follow each other; which of equal rows comes first makes no difference. A document is never divided: it belongs to
the shard in which it begins, so one longer than a shard leaves numbers out. Very long texts aren't read, their n_chars is. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, need

BITS = 6
DIMENSIONS = 3
SHARD_CHARS = 32_000_000
BROADCAST, SALT = 20_000, 32


def curve(n: int = DIMENSIONS) -> tuple[list[int], list[int]]:
    """For state * 2**n + corner: the corner's place on the curve, and the next state. A state is entry * n + direction."""
    size = 1 << n

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & (size - 1)

    def ones(x: int) -> int:
        k = 0
        while x >> k & 1:
            k += 1
        return k

    place, following = [], []
    for state in range(size * n):
        entry, way = divmod(state, n)
        for corner in range(size):
            gray = turn(corner ^ entry, n - (way + 1) % n)
            w, k = gray, gray >> 1
            while k:
                w, k = w ^ k, k >> 1
            start = 0 if w == 0 else (lambda g: g ^ (g >> 1))(2 * ((w - 1) // 2))
            step = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
            place.append(w)
            following.append((entry ^ turn(start, way + 1)) * n + (way + step + 1) % n)
    return place, following


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The index of a cell on the curve; ``levels`` are integers of that many bits."""
    n = len(levels)
    place, following = curve(n)
    states = len(place) >> n
    table = F.array(*[F.lit(int(p * states + f)).cast("bigint") for p, f in zip(place, following)])

    def step(acc: Column, i: Column) -> Column:
        corner = sum((((F.call_function("shiftright", x.cast("bigint"), i)).bitwiseAND(F.lit(1)) * F.lit(1 << k)) for k, x in enumerate(levels)), F.lit(0).cast("bigint"))
        at = F.pmod(acc, F.lit(states)) * F.lit(1 << n) + corner
        return F.floor(acc / F.lit(states)) * F.lit((1 << n) * states) + F.get(table, at.cast("int"))

    walk = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), step)
    return F.floor(walk / F.lit(states)).cast("bigint")


def length_level(n: Column, bits: int = BITS) -> Column:
    """0 to 2**bits - 1, growing with n: four levels a doubling."""
    n = F.greatest(F.coalesce(n.cast("bigint"), F.lit(0)), F.lit(0)) + 4
    top = F.length(F.bin(n)) - 1
    return F.least(F.lit((1 << bits) - 1), (top - 2) * 4 + F.pmod(F.call_function("shiftright", n, top - 2), F.lit(4))).cast("int")


class _Running:
    """Characters before each row: those of earlier partitions, and of earlier rows of this one."""

    def __init__(self, before: dict[int, int]):
        self.before = before

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, chars = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = self.before[int(part[0])] if at is None else at
            ends = at + np.cumsum(chars)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(ends - chars)], names=[*batch.schema.names[2:], "chars_before"])
            at = int(ends[-1])


def _offsets(ordered: DataFrame, amount: str) -> tuple[dict[int, int], int]:
    """What lies before each partition of (part, amount, ...), and in all of them; a row a partition reaches the driver."""
    before, total = {}, 0
    for part, own in sorted(tuple(r) for r in ordered.groupBy("part").agg(F.sum(amount)).collect()):
        before[part], total = total, total + own
    return before, total


def name_levels(docs: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(name, n, level): how many rows have a name, and the rows before it, in alphabetical order, over all rows, times 2**bits."""
    counts = docs.groupBy(F.coalesce(docs[column].cast("string"), F.lit("")).alias("name")).agg(F.count("*").alias("n"))
    ordered = cut(counts.repartitionByRange("name").sortWithinPartitions("name").select(F.spark_partition_id().alias("part"), "n", "name", F.col("n").alias("rows")))
    before, total = _offsets(ordered, "n")
    run = ordered.mapInArrow(_Running(before), "name string, rows bigint, chars_before bigint")
    return run.select("name", F.col("rows").alias("n"), F.floor(F.col("chars_before") * F.lit(1 << bits) / F.lit(max(total, 1))).cast("int").alias("level"))


def _with_level(docs: DataFrame, column: str, level: str, bits: int) -> DataFrame:
    """``docs`` with the level of each row's name. Up to ``BROADCAST`` names, counted first, are broadcast; more are joined with
    ``SALT`` copies of every name, so that a hot name's rows go to as many tasks."""
    key, salt = fresh(docs, "name"), fresh(docs, "salt")
    table = cut(name_levels(docs, column, bits).select(F.col("name").alias(key), F.col("level").alias(level)))
    keyed = docs.withColumn(key, F.coalesce(docs[column].cast("string"), F.lit("")))
    if table.count() <= BROADCAST:
        return keyed.join(F.broadcast(table), key).drop(key)
    table = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keyed = keyed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    return keyed.join(table, [key, salt]).drop(key, salt)


def _placed(docs: DataFrame, source_col: str, lang_col: str, chars_col: str, bits: int) -> DataFrame:
    """``docs`` with __level_source, __level_lang, __level_chars and __hilbert, or such names as are free."""
    names = {k: fresh(docs, k) for k in ("level_source", "level_lang", "level_chars", "hilbert")}
    out = docs
    for column, level in ((source_col, names["level_source"]), (lang_col, names["level_lang"])):
        out = _with_level(out, column, level, bits)
    out = out.withColumn(names["level_chars"], length_level(out[chars_col], bits))
    return out.withColumn(names["hilbert"], hilbert_index([F.col(names[k]) for k in ("level_source", "level_lang", "level_chars")], bits))


def hilbert_sharding(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", bits: int = BITS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``id_col``, the levels, ``hilbert``, ``chars_before`` in the whole order, and ``shard``, for each document."""
    need(docs, id_col, source_col, lang_col, chars_col)
    light = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), docs[lang_col].alias("lang"), F.greatest(F.coalesce(docs[chars_col].cast("bigint"), F.lit(0)), F.lit(0)).alias("chars"))
    placed = _placed(light, "source", "lang", "chars", bits)
    ordered = placed.repartitionByRange("__hilbert", "id", "chars").sortWithinPartitions("__hilbert", "id", "chars")
    ordered = cut(ordered.select(F.spark_partition_id().alias("part"), "chars", "id", "__level_source", "__level_lang", "__level_chars", "__hilbert"))
    before, _ = _offsets(ordered, "chars")
    kind = docs.schema[id_col].dataType.simpleString()
    run = ordered.mapInArrow(_Running(before), f"id {kind}, level_source int, level_lang int, level_chars int, hilbert bigint, chars_before bigint")
    return run.select(F.col("id").alias(id_col), "level_source", "level_lang", "level_chars", "hilbert", "chars_before", F.floor(F.col("chars_before") / F.lit(shard_chars)).cast("bigint").alias("shard"))


def clustered(docs: DataFrame, files: int, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", bits: int = BITS) -> DataFrame:
    """``docs``, all columns, in ``files`` partitions along the curve and sorted in each: what to write as files that prune."""
    placed = _placed(docs, source_col, lang_col, chars_col, bits)
    index = [c for c in placed.columns if c not in docs.columns][-1]
    return placed.repartitionByRange(files, index, id_col).sortWithinPartitions(index, id_col).select(*docs.columns)


def oracle(table: str = "documents", bits: int = BITS, shard_chars: int = SHARD_CHARS) -> str:
    place, following = curve()
    states = len(place) >> DIMENSIONS
    steps = ", ".join(str(p * states + f) for p, f in zip(place, following))
    corner = " + ".join(f"((({c} >> i) & 1) * {1 << k})" for k, c in enumerate(("level_source", "level_lang", "level_chars")))
    size = 1 << DIMENSIONS
    walk = "CAST(0 AS BIGINT)"
    for i in range(bits - 1, -1, -1):
        walk = f"(SELECT id, level_source, level_lang, level_chars, chars, (acc // {states}) * {size * states} + steps[(acc % {states}) * {size} + {corner.replace('>> i', f'>> {i}')} + 1] AS acc FROM {walk if i < bits - 1 else '(SELECT *, CAST(0 AS BIGINT) AS acc FROM levels)'}, curve)"
    level = lambda c: f"SELECT name, CAST(floor(coalesce(sum(n) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} / sum(n) OVER ()) AS INTEGER) AS level FROM (SELECT coalesce({c}, '') AS name, count(*) AS n FROM {table} GROUP BY 1)"
    return f"""
WITH curve AS (SELECT [{steps}] AS steps),
sources AS ({level("source")}), langs AS ({level("lang")}),
light AS (SELECT doc_id AS id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, greatest(coalesce(n_chars, 0), 0) AS chars FROM {table}),
sized AS (SELECT *, chars + 4 AS m, length(ltrim(bin(chars + 4), '0')) - 1 AS top FROM light),
levels AS (SELECT id, s.level AS level_source, l.level AS level_lang, CAST(least({(1 << bits) - 1}, (top - 2) * 4 + (m >> (top - 2)) % 4) AS INTEGER) AS level_chars, chars
  FROM sized JOIN sources s ON s.name = source JOIN langs l ON l.name = lang),
walked AS {walk},
placed AS (SELECT *, acc // {states} AS hilbert FROM walked)
SELECT id AS doc_id, level_source, level_lang, level_chars, hilbert, CAST(chars_before AS BIGINT) AS chars_before, CAST(floor(chars_before / {shard_chars}) AS BIGINT) AS shard
FROM (SELECT *, coalesce(sum(chars) OVER (ORDER BY hilbert, id NULLS FIRST, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_before FROM placed)"""
