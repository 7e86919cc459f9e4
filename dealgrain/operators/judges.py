"""Verdict tables for what rules leave in doubt: scope, provenance, signatures, alignment, order, coherence and floors.

A judge is a table (key, ...): rows in doubt get its columns by key, with the basis judge; doubtful rows without one come back as pending,
once a key, and keep what the rules said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .integrity import payload_key

DOUBT = 0.70
STRONG = ("standard", "acceptable_variants_exist", "hold_firm")


def arbitrate(rows: DataFrame, doubtful: Column, key: Column, verdicts: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``columns`` and basis decided, (key) pending). ``verdicts`` has key and the columns; a null in a verdict leaves the rules' value."""
    asked = rows.withColumn("__doubt", F.coalesce(doubtful, F.lit(False))).withColumn("__key", F.when(F.col("__doubt"), key))
    told = verdicts.select(F.col("key").alias("__key"), *[F.col(c).alias(f"__v_{c}") for c in columns], F.lit(True).alias("__told"))
    both = asked.join(told, "__key", "left")
    judged = F.coalesce("__told", F.lit(False))
    out = both.withColumns({**{c: F.when(judged, F.coalesce(f"__v_{c}", c)).otherwise(F.col(c)) for c in columns}, "basis": F.when(judged, "judge").otherwise(F.col("basis"))})
    pending = both.where(F.col("__doubt") & ~judged).select(F.col("__key").alias("key")).distinct()
    return out.select(*rows.columns), pending


def provenance(documents: DataFrame, verdicts: DataFrame, agreement_type: str = "") -> tuple[DataFrame, DataFrame]:
    """Documents (provenance, basis, confidence, preamble, letterhead) whose rules were unsure, or had no template to compare and no alias."""
    doubt = (F.col("confidence") < DOUBT) | F.col("basis").isin("no_aliases_configured", "alias_absent", "alias_second_party")
    key = payload_key(stage=F.lit("provenance"), preamble=F.col("preamble"), letterhead=F.col("letterhead"), agreement_type=F.lit(agreement_type))
    return arbitrate(documents, doubt, key, verdicts, "provenance", "confidence")


def signed(documents: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions (signed, basis, confidence, section) whose signature section leaves doubt."""
    return arbitrate(documents, F.col("confidence") < DOUBT, payload_key(stage=F.lit("signed"), section=F.col("section")), verdicts, "signed", "confidence")


def scope(documents: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (in_scope, basis, confidence, clause_heads) that are long enough for a verdict."""
    return arbitrate(documents, ~F.col("basis").isin("empty", "too_short"), payload_key(stage=F.lit("scope"), clause_heads=F.col("clause_heads")), verdicts, "in_scope", "confidence")


def trail(order: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders (document_id, version, version_ord, shape, basis) that were taken greedily or have a gap or a fork; a verdict is (key, versions), all of them in order.

    A verdict that doesn't name each version once changes nothing.
    """
    doubt = (F.col("basis") == "greedy") | (F.col("shape") != "linear")
    all_ = order.where(doubt).select("document_id").distinct().withColumnRenamed("document_id", "__document")
    held = order.join(all_, F.col("document_id").eqNullSafe(F.col("__document"))).groupBy("document_id").agg(F.array_sort(F.collect_list("version")).alias("__all"))
    keyed = held.withColumn("__key", payload_key(stage=F.lit("trail"), document=F.col("document_id"), versions=F.array_join(F.transform("__all", lambda x: x.cast("string")), ",")))
    told = keyed.join(verdicts.groupBy(F.col("key").alias("__key")).agg(F.min("versions").alias("__told")), "__key", "left").withColumn("__good", F.coalesce(F.array_sort("__told") == F.col("__all"), F.lit(False)))
    named = told.select(F.col("document_id").alias("__document"), F.col("__good"), F.when(~F.col("__good"), F.col("__key")).alias("__open"), "__told")
    places = named.where("__good").select("__document", F.posexplode("__told").alias("__pos", "__version")).groupBy("__document", "__version").agg((F.min("__pos") + 1).cast("int").alias("__place"))
    # arrays stay with their document, a row each; rows of versions are joined to places
    both = order.join(named.select("__document", "__good"), F.col("document_id").eqNullSafe(F.col("__document")), "left").drop("__document")
    both = both.join(places, F.col("document_id").eqNullSafe(F.col("__document")) & (F.col("version") == F.col("__version")), "left")
    good = F.coalesce(doubt & F.col("__good"), F.lit(False))
    out = both.withColumns({"version_ord": F.when(good, F.col("__place")).otherwise(F.col("version_ord")), "basis": F.when(good, "judge").otherwise(F.col("basis"))})
    return out.select(*order.columns), named.where("__open IS NOT NULL").select(F.col("__open").alias("key")).distinct()


def alignment(clauses: DataFrame, verdicts: DataFrame, low: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Aligned clauses (document_id, taxonomy_id, alignment, confidence, match_basis) of buckets with a clause of its own row or a weak match.

    A verdict is (key, alignment, clause, to): the clause of that bucket goes to another alignment; a clause is named by its hash ``node``.
    """
    bucket = Window.partitionBy("document_id", F.coalesce("taxonomy_id", F.lit("")))
    weak = (F.col("match_basis") == "own_row") | ((F.col("match_basis") == "similarity") & (F.col("confidence") < low))
    keyed = clauses.withColumn("__doubt", F.bool_or(weak).over(bucket)).withColumn("__key", F.when(F.col("__doubt"), payload_key(stage=F.lit("alignment"), document=F.col("document_id"), taxonomy=F.col("taxonomy_id"))))
    asked = verdicts.select("key").distinct()
    both = keyed.join(verdicts.select(F.col("key").alias("__key"), F.col("node"), F.col("to")), ["__key", "node"], "left")
    out = both.withColumns({"alignment": F.coalesce("to", "alignment"), "match_basis": F.when(F.col("to").isNotNull(), "judge").otherwise(F.col("match_basis"))})
    pending = keyed.where("__doubt").select(F.col("__key").alias("key")).distinct().join(asked, "key", "left_anti")
    return out.select(*clauses.columns), pending


def coherence(positions: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions in tension with the flag that a verdict (key, flag) gives, null for coherent ones; pending keys).

    A position is in tension when it is strong without evidence of one's own paper, or negotiable because of a concession although most were held.
    """
    strong = F.col("position").isin(*STRONG) & (F.col("n_our_paper") == 0)
    fallback = (F.col("position") == "negotiable") & (F.col("n_fallbacks") > 0) & (F.col("held") * 2 > F.col("of"))
    tense = positions.where(strong | fallback).withColumn("__key", payload_key(stage=F.lit("coherence"), taxonomy=F.col("taxonomy_id"), position=F.col("position"), n_our_paper=F.col("n_our_paper").cast("string")))
    both = tense.join(verdicts.select(F.col("key").alias("__key"), "flag", F.lit(True).alias("__told")), "__key", "left")
    return both.where("__told").select("taxonomy_id", "position", "flag"), both.where("__told IS NULL").select(F.col("__key").alias("key"), "taxonomy_id").distinct()


def floor(candidates: DataFrame, verdicts: DataFrame, invariants: DataFrame) -> DataFrame:
    """Candidates (candidate_id, taxonomy_id) with a decision: signed where an invariant has their taxonomy, else what a verdict (candidate_id, decision) by a
    person says, else pending. A rejection by the interview alone (by = interview) stays pending."""
    signed_ = invariants.select("taxonomy_id").distinct().withColumn("__signed", F.lit(True))
    told = verdicts.where("by <> 'interview'").select("candidate_id", F.col("decision").alias("__told"))
    both = candidates.join(signed_, "taxonomy_id", "left").join(told, "candidate_id", "left")
    return both.withColumn("decision", F.when(F.col("__signed"), "signed").otherwise(F.coalesce("__told", F.lit("pending")))).drop("__signed", "__told")
