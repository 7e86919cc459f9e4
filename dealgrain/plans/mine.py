"""From version files, or their clauses, to observations, and from observations to a playbook.

Each step is DataFrame to DataFrame; judgements come from verdict tables by key, and what has no verdict comes back as ``pending``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text_ops import STOP_WORDS, dedup_key, party_side
from ..operators import classify, coverage, integrity, redact, rollup, versions
from ..sources import files as folders
from ..sources.config import Config
from . import playbook
from .base import checkpoint

ALIGNED = "document_id string, version_ord int, ord int, alignment bigint, confidence double, match_basis string"


@dataclass
class Mined:
    """What mining gives; every field is a DataFrame."""

    clauses: DataFrame
    scope: DataFrame
    order: DataFrame
    diffs: DataFrame
    reversals: DataFrame
    moves: DataFrame
    observations: DataFrame
    pending: DataFrame
    quarantine: DataFrame


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """One taxonomy's clauses of a document: by position where versions have as many, else each to the most similar of the longest version."""
    words = lambda t: {w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split() if w not in STOP_WORDS}
    by = {v: g.sort_values("ord") for v, g in rows.groupby("version_ord")}
    longest = max(by, key=lambda v: (len(by[v]), -v))
    even = len({len(g) for g in by.values()}) == 1
    heads = [int(k) for k in by[longest]["node"]]
    sets = [words(t) for t in by[longest]["text"]]
    out = []
    for v, g in by.items():
        place = {i: (heads[i], 1.0, "position") for i in range(len(g))} if even or v == longest else {}
        if not place:
            scored = sorted(((len(a & b) / len(a | b) if a | b else 1.0, i, j) for (i, a), (j, b) in itertools.product(enumerate(map(words, g["text"])), enumerate(sets))), key=lambda x: (-x[0], x[1], x[2]))
            taken: set[int] = set()
            for s, i, j in scored:
                if s > 0 and i not in place and j not in taken:
                    place[i] = (heads[j], s, "similarity")
                    taken.add(j)
        for i, r in enumerate(g.itertuples()):
            a, s, b = place.get(i, (int(r.node), 0.0, "own_row"))
            out.append((r.document_id, r.version_ord, r.ord, a, s, b))
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in ALIGNED.split(", ")])


def align(clauses: DataFrame) -> DataFrame:
    """Clauses (document_id, version_ord, ord, text, taxonomy_id, …) with alignment, confidence and match_basis: moved ones first, then by taxonomy."""
    base = checkpoint(clauses)
    chained = checkpoint(versions.chains(versions.moves(base.select("document_id", "version_ord", "ord", "text"), checkpoint), base, checkpoint))
    moved = chained.where("match_basis <> 'none'")
    rest = chained.where("match_basis = 'none'").withColumn("node", F.col("alignment")).select("document_id", "version_ord", "ord", "text", "taxonomy_id", "node")
    spots = rest.groupBy("document_id", F.coalesce("taxonomy_id", F.lit(""))).applyInPandas(lambda rows: _bucket(rows), ALIGNED)
    placed = chained.drop("alignment", "confidence", "match_basis").join(spots, ["document_id", "version_ord", "ord"])
    return moved.unionByName(placed)


def observe(net: DataFrame, reversed_: DataFrame, documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Observations of net diffs and of reversals that no diff covers.

    ``net`` has document_id, alignment, taxonomy_id, clause_path, before, after, kind, deviation, basis and confidence; ``documents`` has
    document_id, provenance, signed and versions; ``verdicts`` has key, deviation, direction and magnitude.
    """
    key = integrity.payload_key(stage=F.lit("deviation"), hunk=F.concat_ws("\n", "before", "after"), our_standard=F.coalesce("our_standard", F.lit("")))
    seen = net.withColumn("key", key).join(verdicts.select("key", F.col("deviation").alias("v_deviation"), "direction", "magnitude"), "key", "left").join(documents, "document_id")
    # a clause reversed in several rounds counts once, with what was proposed first
    back = reversed_.groupBy("document_id", "alignment").agg(F.min_by("proposed_text", "round").alias("proposed_text")).withColumn("reversed", F.lit(True))
    rows = seen.join(back, ["document_id", "alignment"], "left")
    outcome = F.when(F.col("reversed") & (F.col("kind").isin("removed", "unchanged")), "proposed_then_reversed").when(F.col("signed"), "signed").otherwise("unsigned")
    judged = F.col("basis") == "pending"
    neutral = F.coalesce("deviation", F.when(judged, F.col("v_deviation")), F.lit("needs_review"))
    base = rows.select(
        "document_id", "alignment", "taxonomy_id", "clause_path", F.coalesce("after", "before").alias("full_text"), neutral.alias("deviation"), F.when(neutral == "none", "neutral").otherwise(F.coalesce("direction", F.lit("neutral"))).alias("direction"),
        F.when(neutral == "none", "none").otherwise(F.coalesce("magnitude", F.lit("none"))).alias("magnitude"), "provenance", outcome.alias("outcome"),
        F.when(judged, F.when(F.col("v_deviation").isNull(), "needs_review").otherwise("judge")).otherwise(F.col("basis")).alias("basis"), F.col("versions").alias("version"), "confidence",
    )
    lost = back.join(net.select("document_id", "alignment"), ["document_id", "alignment"], "left_anti").join(documents, "document_id")
    extra = lost.select("document_id", "alignment", F.lit(None).cast("string").alias("taxonomy_id"), F.lit("?").alias("clause_path"), F.col("proposed_text").alias("full_text"), F.lit("substantive").alias("deviation"), F.lit("neutral").alias("direction"), F.lit("none").alias("magnitude"), "provenance", F.lit("proposed_then_reversed").alias("outcome"), F.lit("reversal").alias("basis"), F.col("versions").alias("version"), F.lit(None).cast("double").alias("confidence"))
    every = base.unionByName(extra).withColumn("base_id", F.concat_ws(":", "document_id", F.col("version").cast("string"), "clause_path")).withColumn("ord", F.xxhash64("document_id", "alignment"))
    return versions.numbered(every, "base_id", "alignment").drop("base_id")


def scoped(sizes: DataFrame, scopes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(documents with in_scope, basis, confidence and scope_rationale; pending keys of kind scope).

    ``scopes`` has document_id, in_scope and scope_rationale. Documents of two clauses or more without a verdict stay in scope and are pending.
    """
    docs = sizes.groupBy("document_id").agg(F.max("n").alias("n_clauses"))
    if scopes is None:
        return coverage.scope_ladder(docs.withColumn("verdict", F.lit(None).cast("boolean"))).withColumn("scope_rationale", F.lit(None).cast("string")), docs.select("document_id").limit(0)
    told = docs.join(scopes.select("document_id", F.col("in_scope").alias("verdict"), "scope_rationale"), "document_id", "left")
    out = coverage.scope_ladder(told)
    return out, out.where("basis = 'judge_failed'").select("document_id")


def mine(spark: SparkSession, clauses: DataFrame, taxonomy: DataFrame, aliases: list[str], verdicts: DataFrame, classifications: DataFrame | None = None, standards: DataFrame | None = None, quarantine: DataFrame | None = None,
         scopes: DataFrame | None = None, hints: DataFrame | None = None, settings: Config | None = None, template: str | None = None) -> Mined:
    """Clauses are rows (document_id, version, ord, clause_path, heading, text); versions are numbers in file order.

    ``verdicts`` has key, deviation, direction and magnitude; ``classifications`` has clause and verdict_id, ``standards`` taxonomy_id and our_standard,
    ``scopes`` document_id, in_scope and scope_rationale, ``hints`` what ``config.hints`` gives. ``settings`` has the thresholds, aliases and known entities; ``template`` is
    the text of our own paper. A document's hinted signed version and provenance go before what its text says.
    """
    settings = settings or Config({"id": ""})
    aliases = list(dict.fromkeys([*aliases, *settings.aliases]))
    source = F.regexp_replace("source_file", r"\.[^.]+$", "") if "source_file" in clauses.columns else F.lit(None).cast("string")
    rows = checkpoint(clauses.where("ord >= 0").select("document_id", F.col("version").cast("bigint").alias("version"), F.coalesce(source, F.col("version").cast("string")).alias("name"), "ord", "clause_path", "heading", F.coalesce("text", F.lit("")).alias("text")))
    sizes = rows.groupBy("document_id", "version").agg(F.min("name").alias("name"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading", "text"))), lambda x: F.concat_ws("\n", x["heading"], x["text"])), "\n").alias("text"))
    sizes = checkpoint(sizes)
    scope, unscoped = scoped(sizes, scopes)
    live = sizes.join(scope.where("in_scope").select("document_id"), "document_id")
    status = classify.signed_status(live).select("document_id", "version", "name", "text", F.col("signed").alias("looks"), "confidence")
    if hints is not None:
        said = hints.select("document_id", "signed_version", F.col("provenance").alias("hinted"))
        status = status.join(said, "document_id", "left").withColumn("looks", F.when(F.col("signed_version").isNull(), F.col("looks")).otherwise(F.col("name") == F.col("signed_version"))).drop("signed_version")
    else:
        status = status.withColumn("hinted", F.lit(None).cast("string"))
    status = checkpoint(status)
    best = Window.partitionBy("document_id").orderBy(F.desc("looks"), F.desc("confidence"), F.desc("version"))
    status = status.withColumn("signed", (F.row_number().over(best) == 1) & F.col("looks"))
    ids = status.select("document_id").distinct().withColumn("doc_key", F.xxhash64("document_id"))
    keyed = lambda df: df.join(ids, "document_id").drop("document_id").withColumnRenamed("doc_key", "document_id")
    ordered = versions.order_versions(keyed(status.select("document_id", "version", "name", "text", "signed")), keyed(hints.select("document_id", "version_order", "timestamps")) if hints is not None else None)
    ordered = checkpoint(ordered.withColumnRenamed("document_id", "doc_key").join(ids, "doc_key").drop("doc_key"))
    first = ordered.where("version_ord = 1").select("document_id", "version").join(status.select("document_id", "version", "text", "hinted"), ["document_id", "version"])
    likeness = "similarity" if template else None
    paper = classify.provenance(versions.template_similarity(first, template) if template else first, aliases, similarity=likeness).select("document_id", F.coalesce("hinted", "provenance").alias("provenance"))
    documents = ordered.groupBy("document_id").agg(F.max("version_ord").alias("versions")).join(status.groupBy("document_id").agg(F.bool_or("signed").alias("signed")), "document_id").join(paper, "document_id")
    numbered = rows.drop("name").join(ordered.select("document_id", "version", "version_ord"), ["document_id", "version"]).withColumn("clause", F.concat_ws(":", "document_id", F.col("version").cast("string"), "clause_path"))
    named = checkpoint(classify.classify(numbered, taxonomy, classifications, settings.auto, settings.ambiguity).withColumnRenamed("basis", "class_basis").withColumnRenamed("confidence", "class_confidence"))
    aligned = checkpoint(align(named))
    diffs = checkpoint(versions.with_hunks(versions.consecutive_diff(aligned)))
    back = checkpoint(versions.reversals(diffs, aligned))
    last = aligned.groupBy("document_id", "alignment").agg(F.max_by("taxonomy_id", "version_ord").alias("taxonomy_id"), F.max_by("clause_path", "version_ord").alias("clause_path"), F.min("confidence").alias("confidence"))
    net = checkpoint(versions.deviations(versions.net_diff(aligned).join(last, ["document_id", "alignment"]), standards))
    observations = observe(net, back, documents, verdicts)
    if settings.known_entities:
        entities = spark.createDataFrame([(e,) for e in settings.known_entities], "entity string")
        refs = redact.entity_in_id(observations.select("document_id").distinct(), entities).select("document_id", F.col("entity").alias("counterparty_ref"))
        observations = observations.join(refs, "document_id", "left")
    observations = checkpoint(observations)
    wait = net.where("basis = 'pending'").withColumn("key", integrity.payload_key(stage=F.lit("deviation"), hunk=F.concat_ws("\n", "before", "after"), our_standard=F.coalesce("our_standard", F.lit(""))))
    _, pending = integrity.with_verdicts(wait.select("key", F.lit("deviation").alias("kind"), "taxonomy_id", "document_id", "before", "after"), verdicts)
    unread = named.where("class_basis = 'pending'").select(integrity.payload_key(stage=F.lit("classify"), text=F.col("text"), heading=F.col("heading")).alias("key"), F.lit("classify").alias("kind"), F.lit(None).cast("string").alias("taxonomy_id"), "document_id", F.col("heading").alias("before"), F.col("text").alias("after")).dropDuplicates(["key"])
    heads = rows.where("heading is not null").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("heading")), "\n").alias("heads"))
    open_ = unscoped.join(heads, "document_id", "left").select(integrity.payload_key(stage=F.lit("scope"), document_id=F.col("document_id"), clause_heads=F.col("heads")).alias("key"), F.lit("scope").alias("kind"), F.lit(None).cast("string").alias("taxonomy_id"), "document_id", F.lit(None).cast("string").alias("before"), F.col("heads").alias("after"))
    empty = spark.createDataFrame([], "document_id string, version string, source_file string, reason string")
    return Mined(aligned, scope, ordered, diffs, back, versions.round_moves(diffs), observations, pending.unionByName(unread).unionByName(open_), quarantine if quarantine is not None else empty)


def mine_folder(spark: SparkSession, root: str, taxonomy: DataFrame, aliases: list[str], verdicts: DataFrame, **how) -> Mined:
    parsed = checkpoint(folders.parsed(folders.scan(spark, root)))
    return mine(spark, parsed, taxonomy, aliases, verdicts, quarantine=folders.quarantined(parsed), **how)


def project(mined: Mined, agreement: dict, standards: DataFrame | None = None, min_evidence: int = rollup.MIN_EVIDENCE, **parts) -> dict:
    """A playbook document of mined observations; a stance needs ``min_evidence`` of them on own paper."""
    forms = rollup.ranked_forms(rollup.counted(mined.observations).withColumn("precedent_count", F.lit(1)).withColumn("material", F.col("magnitude") == "material"), dedup_key(F.col("full_text")))
    documents = mined.order.groupBy("document_id").agg(F.max("version_ord").alias("versions"))
    return playbook.assemble(agreement, rollup.rollup(mined.observations, standards, min_evidence), documents, forms, **parts)


def moved_by(moves: DataFrame, changes: DataFrame, aliases: list[str]) -> DataFrame:
    """Moves with the side of the first author of a tracked change in the version they lead to."""
    first = changes.groupBy("document_id", (F.col("version").cast("int") - 1).alias("round")).agg(F.min_by("author", "line").alias("author"))
    return moves.join(first, ["document_id", "round"], "left").withColumn("moved_by", party_side(F.col("author"), aliases)).drop("author")
