"""Clause trees as flat rows: numbered and capital headings open clauses, other lines are the text of the open one."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = re.compile(r"([0-9]+(?:[.][0-9]+)*)[).](?![0-9])[ \t]*")
CLAUSES = "document_id string, version string, source_file string, ord int, clause_path string, parent_path string, depth int, heading string, text string, start int, end int, page int"


def heading_level(line: str) -> int | None:
    """Depth of a number like 1.2), 1 for a short line of capitals, None for text."""
    if m := _NUMBER.match(line):
        return m[1].count(".") + 1
    parts = line.split()
    capital = line.isascii() and line.upper() == line and re.search("[A-Za-z]", line) and not line.endswith(".")
    return 1 if parts and len(parts) <= 8 and capital else None


def build(lines: Iterable[tuple[str, int]]) -> Iterator[dict]:
    """Rows in order of (line, level or 0); text before any heading is clause 0."""
    open_: list[tuple[int, dict]] = []
    rows: list[dict] = []
    used: dict[tuple[str, int], int] = {}
    at = 0
    for line, given in lines:
        level = given or heading_level(line)
        if level is None:
            if not open_:
                rows.append({"clause_path": "0", "parent_path": None, "heading": None, "text": "", "start": at})
                open_.append((0, rows[-1]))
            row = open_[-1][1]
            row["text"] = f"{row['text']}\n{line}" if row["text"] else line
            row["end"] = at + len(line)
        else:
            while open_ and open_[-1][0] >= level:
                open_.pop()
            parent = open_[-1][1]["clause_path"] if open_ else None
            m = _NUMBER.match(line)
            if m:
                path, title = m[1], line[m.end() :].strip()
            else:
                key = (parent or "", level)
                used[key] = used.get(key, 0) + 1
                path, title = f"{parent}.{used[key]}" if parent else str(used[key]), line
            rows.append({"clause_path": path, "parent_path": parent, "heading": title or None, "text": "", "start": at, "end": at + len(line)})
            open_.append((level, rows[-1]))
        at += len(line) + 1
    depth: dict[str | None, int] = {None: 0}
    for k, row in enumerate(rows):
        depth[row["clause_path"]] = depth.get(row["parent_path"], 0) + 1
        yield {**row, "ord": k, "depth": depth[row["clause_path"]]}


_LETTERED = re.compile(r"(?:(?<=\s)|^)\(([a-z]|[ivx]{2,5})\)\s+")
_ROMAN = "i ii iii iv v vi vii viii ix x xi xii".split()


def split_items(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(text before, [(mark, item)]) where (a), (b)… or (i), (ii)… follow each other from the first on; none else."""
    marks = list(_LETTERED.finditer(text))
    for series in (_ROMAN, [chr(c) for c in range(97, 123)]):
        held, want = [], 0
        for m in marks:
            if want < len(series) and m[1] == series[want]:
                held.append(m)
                want += 1
        if len(held) >= 2:
            ends = [m.start() for m in held[1:]] + [len(text)]
            return text[: held[0].start()].strip(), [(m[1], text[m.end() : e].strip()) for m, e in zip(held, ends)]
    return text, []


def tree_problems(clauses: DataFrame) -> DataFrame:
    """Paths that repeat, parents that are missing, and spans that end before they begin or start before the one before."""
    doc = ["document_id", "version"]
    w = Window.partitionBy(*doc).orderBy("ord")
    base = clauses.withColumn("__last", F.lag("start").over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*doc, "clause_path")))
    paths = clauses.select(*doc, F.col("clause_path").alias("parent_path"), F.lit(True).alias("__known")).distinct()
    both = base.join(paths, [*doc, "parent_path"], "left")
    problem = F.when(F.col("__n") > 1, "duplicate_path").when(F.col("parent_path").isNotNull() & F.col("__known").isNull(), "missing_parent").when(F.col("end") < F.col("start"), "inverted_span").when(F.col("start") < F.col("__last"), "span_order")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*doc, "clause_path", "problem")


def blocks(lines: DataFrame) -> DataFrame:
    """(document_id, version, ord, text) with the spans of lines joined by line feeds."""
    w = Window.partitionBy("document_id", "version").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(w) - 1
    return lines.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("text")).cast("int"))


def leaves(clauses: DataFrame) -> DataFrame:
    parents = clauses.select("document_id", "version", F.col("parent_path").alias("clause_path")).where("clause_path IS NOT NULL").distinct()
    return clauses.join(parents, ["document_id", "version", "clause_path"], "left_anti")
