"""Segmentations of a text: grounding nodes in blocks, the checks that gate them, and readings of a document's beginning.

Nodes are rows (document_id, node_id, parent_id, ord, start_block, end_block, taxonomy_id), blocks rows (document_id, block_id, ord, start, end, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grounded(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes with the span and text of their blocks, in order; nodes whose blocks are unknown have null spans."""
    b = blocks.select("document_id", F.col("block_id"), F.col("ord").alias("b_ord"), "start", "end", "text")
    first = nodes.join(b.select("document_id", F.col("block_id").alias("start_block"), F.col("b_ord").alias("first_ord")), ["document_id", "start_block"], "left")
    both = first.join(b.select("document_id", F.col("block_id").alias("end_block"), F.col("b_ord").alias("last_ord")), ["document_id", "end_block"], "left")
    inside = both.join(b, (both.document_id == b.document_id) & (b.b_ord >= both.first_ord) & (b.b_ord <= both.last_ord), "left").drop(b.document_id)
    keys = [c for c in both.columns if c not in ("first_ord", "last_ord")]
    pieces = F.array_sort(F.collect_list(F.when(F.col("b_ord").isNotNull(), F.struct("b_ord", "text"))))
    return inside.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(pieces, lambda x: x["text"]), "\n").alias("text"))


def endless(nodes: DataFrame, checkpoint: Callable) -> DataFrame:
    """(document_id, node_id) of nodes whose chain of parents never ends.

    Each round doubles the steps that are taken at once, so rounds grow with the logarithm of the longest chain; those left when a round
    drops nobody are in a cycle or below one.
    """
    up = nodes.where("parent_id IS NOT NULL").groupBy("document_id", "node_id").agg(F.min("parent_id").alias("up"))
    left = checkpoint(up)
    n = left.count()
    while n:
        step = left.select("document_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        left = checkpoint(left.join(step, ["document_id", "up"]).select("document_id", "node_id", F.col("next").alias("up")))
        if (now := left.count()) == n:
            break
        n = now
    return left.select("document_id", "node_id")


def grounding_problems(nodes: DataFrame, blocks: DataFrame, checkpoint: Callable) -> DataFrame:
    """Unknown blocks, unknown parents, ids that repeat, ends before beginnings, and nodes whose parents never lead to a root."""
    ids = nodes.groupBy("document_id", F.col("node_id").alias("parent_id")).agg(F.lit(True).alias("known"))
    b = blocks.select("document_id", "block_id", F.col("ord").alias("o"))
    x = nodes.withColumn("n", F.count("*").over(Window.partitionBy("document_id", "node_id"))).join(ids, ["document_id", "parent_id"], "left")
    x = x.join(b.select("document_id", F.col("block_id").alias("start_block"), F.col("o").alias("o1")), ["document_id", "start_block"], "left").join(b.select("document_id", F.col("block_id").alias("end_block"), F.col("o").alias("o2")), ["document_id", "end_block"], "left")
    x = x.join(endless(nodes, checkpoint).withColumn("endless", F.lit(True)), ["document_id", "node_id"], "left")
    problem = F.when(F.col("n") > 1, "duplicate_node").when(F.col("o1").isNull() | F.col("o2").isNull(), "unknown_block").when(F.col("o2") < F.col("o1"), "inverted").when(F.col("endless"), "cycle").when(F.col("parent_id").isNotNull() & F.col("known").isNull(), "unknown_parent")
    return x.withColumn("problem", problem).where("problem IS NOT NULL").select("document_id", "node_id", "problem")


def uncovered_text(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Gaps between a document's spans that hold more than blanks, and overlaps; spans (document_id, start, end), texts (document_id, text)."""
    w = Window.partitionBy("document_id").orderBy("start", "end")
    s = spans.select("document_id", "start", "end", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("before"), (F.row_number().over(w) == F.count("*").over(Window.partitionBy("document_id"))).alias("is_last"))
    x = s.join(texts, "document_id")
    gap = F.substring(F.col("text"), F.col("before") + 1, F.col("start") - F.col("before"))
    tail = F.when(F.col("is_last"), F.substring(F.col("text"), F.col("end") + 1, F.length("text"))).otherwise(F.lit(""))
    problem = F.when(F.col("start") < F.col("before"), "overlap").when(F.trim(F.translate(gap, "\n\t\r", "   ")) != "", "gap").when(F.trim(F.translate(tail, "\n\t\r", "   ")) != "", "tail")
    return x.withColumn("problem", problem).where("problem IS NOT NULL").select("document_id", "start", "end", "problem")


def unfaithful(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents whose leaf texts, in order and without blanks, aren't the whole text without blanks; nodes (document_id, ord, text)."""
    bare = lambda c: F.translate(c, " \n\t\r", "")
    made = nodes.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("made"))
    return texts.join(made, "document_id", "left").where(bare(F.coalesce("made", F.lit(""))) != bare(F.col("text"))).select("document_id")


def unknown_taxonomy(nodes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return nodes.where("taxonomy_id is not null").join(taxonomy.select(F.col("id").alias("taxonomy_id")), "taxonomy_id", "left_anti")


def resolve_span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def opening(text: Column, chars: int = 1000) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def preamble(text: Column, lines: int = 5) -> Column:
    """The first lines that aren't blank."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, lines), "\n")


def letterheads(clauses: DataFrame) -> DataFrame:
    """The first heading of each version."""
    return clauses.where("heading is not null").groupBy("document_id", "version").agg(F.min_by("heading", "ord").alias("letterhead"))


def mentions(clauses: DataFrame, aliases: list[str]) -> DataFrame:
    """Whether any alias occurs anywhere in each document."""
    text = F.lower(F.concat_ws("\n", "heading", "text"))
    hit = F.lit(False)
    for a in aliases:
        hit = hit | text.contains(a.lower())
    return clauses.groupBy("document_id").agg(F.bool_or(hit).alias("mentioned"))


def thin(positions: DataFrame) -> DataFrame:
    """Positions without enough evidence, or every form of which was seen once; positions has evidence_sufficient and precedent_counts."""
    once = (F.size("precedent_counts") > 0) & F.forall("precedent_counts", lambda n: n == 1)
    return positions.withColumn("thin", (~F.coalesce("evidence_sufficient", F.lit(True))) | F.coalesce(once, F.lit(False)))


def block_spans(blocks: DataFrame, document: str = "document_id", order: str = "ord", text: str = "text") -> DataFrame:
    """Blocks with start and end in the text that they make when joined by line feeds."""
    run = F.sum(F.length(text) + 1).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("end", (run - 1).cast("bigint")).withColumn("start", (F.col("end") - F.length(text)).cast("bigint"))


def capitals(line: Column, most: int = 8) -> Column:
    """A line of capitals, of few words and without a full stop, reads as a heading."""
    return line.rlike("[A-Z]") & (F.upper(line) == line) & (F.size(F.split(line, " ")) <= most) & ~line.rlike("[^ -~]") & ~line.endswith(".")


def owned(rows: DataFrame, heading: Column, document: str = "document_id", order: str = "ord") -> DataFrame:
    """Lines with the heading that they are below and its number; ``heading`` is null for lines that are none."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).withColumn("clause_no", F.count(heading).over(w))


ELEMENT = r"<(h1|p|li|title)[^>]*>([^<]*)"


def html_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ord from 1, tag, text): headings, paragraphs and list items of a page."""
    tags, text = (F.regexp_extract_all(html, F.lit(ELEMENT), k) for k in (1, 2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(tags.alias("tag"), text.alias("text"))).alias("pos", "x"))
    return rows.select(key, (F.col("pos") + 1).alias("ord"), "x.tag", "x.text")
