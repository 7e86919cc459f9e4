"""Integrity queries: citations, duplicates, spans, multisets, coverage gates, pins and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bad_citations(citations: DataFrame, corpus: DataFrame, document: str = "document_id", version: str = "version", versions: str = "versions", template: str | None = None) -> DataFrame:
    """Citations of a document that isn't in the corpus or of a version that it hasn't, with the problem.

    ``corpus`` has a row a document and its number of versions; rows whose ``template`` flag holds are fine as they are.
    """
    if template:
        citations = citations.where(~F.coalesce(F.col(template), F.lit(False)))
    both = citations.join(corpus.select(F.col(document).alias("__doc"), F.col(versions).alias("__n")), F.col(document) == F.col("__doc"), "left")
    problem = F.when(F.col("__doc").isNull(), "unknown_document").when((F.col(version) < 1) | (F.col(version) > F.col("__n")), "unknown_version")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").drop("__doc", "__n")


def duplicates(rows: DataFrame, *key) -> DataFrame:
    """Keys that several rows have, and how many."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def span_problems(spans: DataFrame, document: str, order: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that overlap the one before, leave a gap after it, or end before they start."""
    last = F.lag(end).over(Window.partitionBy(document).orderBy(order))
    gap = F.col(start) - last
    kind = F.when(F.col(end) < F.col(start), "inverted").when(gap < 0, "overlap").when(gap > 1, "gap")
    return spans.withColumn("gap", gap).withColumn("problem", kind).where("problem IS NOT NULL")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def uncovered(required: DataFrame, evaluated: DataFrame, *key: str) -> DataFrame:
    """Required rows that weren't evaluated; a gate passes when there is none."""
    return required.join(evaluated, list(key), "left_anti")


class CoverageError(ValueError):
    """A gate's rows weren't all evaluated."""


def coverage_gate(required: DataFrame, evaluated: DataFrame, *key: str) -> None:
    """Raises unless every required row was evaluated."""
    missing = uncovered(required, evaluated, *key).limit(5).collect()
    if missing:
        raise CoverageError(f"not evaluated: {[tuple(r) for r in missing]}")


def merge_pins(pins: DataFrame, stances: DataFrame, key: str = "clause_id") -> DataFrame:
    """Pins (key, position, baseline_stance) against new stances (key, stance): a conflict where the stance has changed.

    A pin whose clause is gone stays as it is.
    """
    both = pins.join(stances.select(key, "stance"), key, "left")
    changed = F.col("stance").isNotNull() & ~F.col("stance").eqNullSafe(F.col("baseline_stance"))
    return both.select(key, "position", "baseline_stance", F.when(changed, F.col("stance")).alias("conflict_stance"), changed.alias("conflict"), F.col("stance").isNull().alias("orphan"))


def merge_taxonomy(existing: DataFrame, upstream: DataFrame) -> DataFrame:
    """Existing entries as they are, and upstream ids that are new as inactive ones."""
    new = upstream.join(existing.select("id"), "id", "left_anti").withColumn("status", F.lit("inactive"))
    return existing.unionByName(new.select(*existing.columns))


def latest_verdicts(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last entry of each key of an append-only log."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("x")).select(key, "x.*")


def with_verdicts(items: DataFrame, verdicts: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(items with their verdicts, distinct pending items without one)."""
    return items.join(verdicts, key), items.join(verdicts.select(key), key, "left_anti").dropDuplicates([key])


def payload_key(**fields) -> F.Column:
    """SHA-256 of the fields' canonical JSON: keys sorted, no blanks, nulls kept."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(_quoted(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def _quoted(c: F.Column) -> F.Column:
    return F.substring(F.to_json(F.array(c.cast("string"))), F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2)


def invalid_verdicts(verdicts: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Verdicts (key, kind, value) of an unknown kind or with a value that the kind doesn't have."""
    kind, problem = F.col("kind"), F.when(~F.col("kind").isin(*allowed) | F.col("kind").isNull(), "unknown_kind")
    for k, values in allowed.items():
        problem = problem.when((kind == k) & (F.col("value").isNull() | ~F.col("value").isin(*values)), "bad_value")
    return verdicts.withColumn("problem", problem).where("problem IS NOT NULL")


def resolve_citations(citations: DataFrame, version_files: DataFrame, files: DataFrame) -> DataFrame:
    """Citations with the path of the file whose hash their version has; null where none has it."""
    addressed = citations.join(version_files.select("document_id", "version", "sha256"), ["document_id", "version"], "left")
    return addressed.join(files.groupBy("sha256").agg(F.min("path").alias("path")), "sha256", "left").withColumn("problem", F.when(F.col("sha256").isNull(), "unaddressable").when(F.col("path").isNull(), "not_found"))


def tree_hash(rows: DataFrame, line: F.Column, *group: str, digits: int = 3) -> DataFrame:
    """(group, n, digest): SHA-256 of a multiset of lines, the same whatever the order and partitioning of the rows.

    The first ``digits`` of a line's own SHA-256 name its leaf; a leaf is the hash of its lines' hashes in order, and the digest that of the
    leaves in order. With 3 digits the root has at most 4,096 members, and a leaf of a billion lines about 250,000.
    """
    each = rows.select(*group, F.sha2(line, 256).alias("h"))
    of = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    leaves = each.groupBy(*group, F.substring("h", 1, digits).alias("leaf")).agg(F.count("*").alias("n"), of("h").alias("h"))
    return leaves.groupBy(*group).agg(F.sum("n").cast("bigint").alias("n"), of(F.concat("leaf", F.lit(":"), "h")).alias("digest"))


def manifest_hash(versions: DataFrame) -> DataFrame:
    """One row: the hash of all (document_id, version, sha256) lines, whatever their number and order."""
    line = F.concat_ws("|", F.col("document_id").cast("string"), F.col("version").cast("string"), F.col("sha256"))
    return tree_hash(versions, line).select(F.col("digest").alias("manifest_hash"))
