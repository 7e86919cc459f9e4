"""Clause positions from observations: one aggregation by taxonomy, then a cascade over its columns.

Observations have taxonomy_id, document_id, version, clause_path, full_text, deviation, direction, magnitude,
provenance, outcome, basis and ord, the order in which they were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_ops import band, dedup_key, normalize

COUNTED = ("signed", "proposed_then_reversed")
UNJUDGED = ("stub", "needs_review")
OUR, THEIR = "our_paper", "counterparty_paper"
MIN_EVIDENCE = 2
STANCES = {"acceptable_variants_exist": "usually_held", **dict.fromkeys(("hold_firm", "standard"), "consistently_held")}


def counted(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("taxonomy_id").isNotNull() & F.col("outcome").isin(*COUNTED))


def _judged() -> Column:
    return ~F.coalesce(F.col("basis"), F.lit("")).isin(*UNJUDGED)


def _text_counts(observations: DataFrame) -> DataFrame:
    """(taxonomy_id, full_text, precedent_count): texts are counted before they are summed by key, so a frequent text is combined where it is read."""
    texts = observations.groupBy("taxonomy_id", "full_text").agg(F.count("*").alias("n"))
    same = Window.partitionBy("taxonomy_id", dedup_key(F.col("full_text")))
    return texts.select("taxonomy_id", "full_text", F.sum("n").over(same).cast("bigint").alias("precedent_count"))


def precedents(observations: DataFrame) -> DataFrame:
    """precedent_count: observations of the same taxonomy with the same text but for case and blanks."""
    c = _text_counts(observations).select(F.col("taxonomy_id").alias("__t"), F.col("full_text").alias("__x"), "precedent_count")
    return observations.join(c, F.col("taxonomy_id").eqNullSafe(F.col("__t")) & F.col("full_text").eqNullSafe(F.col("__x"))).drop("__t", "__x")


def rollup(observations: DataFrame, standards: DataFrame | None = None, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """A row for each taxonomy: counts, confidence, held and of, position and historical stance.

    ``standards`` has taxonomy_id and our_standard; without it every taxonomy counts as having one. The position
    is negotiable for want of own paper, a standard, judged evidence or enough of it, in that order, and only then derived.
    """
    ours, signed, reversed_ = F.col("provenance") == OUR, F.col("outcome") == "signed", F.col("outcome") == "proposed_then_reversed"
    worse, neutral = F.col("direction") == "worse", F.col("direction") == "neutral"
    held = reversed_ | F.coalesce(~worse, F.lit(True))
    n = lambda c: F.count_if(c).cast("bigint")
    g = counted(observations).groupBy("taxonomy_id").agg(
        F.count("*").cast("bigint").alias("n_observations"), n(ours).alias("n_our_paper"), n(F.col("provenance") == THEIR).alias("n_counterparty_paper"),
        n(signed & neutral & (F.col("deviation") != "none") & _judged()).alias("n_acceptable"), n(ours & signed & worse).alias("n_fallbacks"), n(reversed_).alias("n_rejected"),
        n(ours & reversed_).alias("n_our_rejected"), n(ours & signed & neutral & (F.col("deviation") != "none") & _judged()).alias("n_our_variants"),
        n(F.coalesce(F.col("basis"), F.lit("")) == "stub").alias("n_stub"), n(ours & held).alias("held_ours"), n(held).alias("held_all"),
    )
    if standards is not None:
        g = g.join(standards.select("taxonomy_id", F.lit(True).alias("has_standard")), "taxonomy_id", "left")
    else:
        g = g.withColumn("has_standard", F.lit(True))
    total = F.col("n_our_paper") + F.col("n_counterparty_paper")
    score = F.when(total > 0, F.bround((F.col("n_our_paper") + 0.5 * F.col("n_counterparty_paper")) / total, 3)).otherwise(F.lit(0.0))
    has = F.coalesce(F.col("has_standard"), F.lit(False))
    enough = F.col("n_our_paper") >= min_evidence
    position = (
        F.when(F.col("n_our_paper") == 0, "negotiable").when(~has, "negotiable").when(F.col("n_stub") > 0, "negotiable").when(~enough, "negotiable")
        .when(F.col("n_fallbacks") > 0, "negotiable").when(F.col("n_our_variants") > 0, "acceptable_variants_exist").when(F.col("n_our_rejected") > 0, "hold_firm").otherwise("standard")
    )
    settled = F.lit(None).cast("string")
    for p, s in STANCES.items():
        settled = F.when(F.col("position") == p, s).otherwise(settled)
    stance = F.when((F.col("n_stub") > 0) | ~enough, "no_signal").when(F.col("position") == "negotiable", F.when(F.col("n_our_rejected") > 0, "mixed").otherwise("usually_conceded")).otherwise(settled)
    out = g.withColumn("score", score).withColumn("evidence_sufficient", enough).withColumn("position", position)
    stance = F.when(~has & ~stance.isin("mixed", "no_signal"), "no_signal").otherwise(stance)
    by_ours = F.col("n_our_paper") > 0
    return out.select(
        "taxonomy_id", "n_observations", "n_our_paper", "n_counterparty_paper", "score", "evidence_sufficient", "n_acceptable", "n_fallbacks", "n_rejected",
        F.when(by_ours, F.col("held_ours")).otherwise(F.col("held_all")).alias("held"), F.when(by_ours, F.col("n_our_paper")).otherwise(F.col("n_observations")).alias("of"),
        F.when(by_ours, "our_paper").otherwise("all").alias("detail_basis"), "position", stance.alias("historical_stance"),
    )


def fallbacks(observations: DataFrame) -> DataFrame:
    """Own-paper concessions of each taxonomy, the least material first, then in the order made."""
    size = F.when(F.col("magnitude") == "none", 0).when(F.col("magnitude") == "minor", 1).when(F.col("magnitude") == "material", 2).otherwise(0)
    own = precedents(counted(observations)).where((F.col("provenance") == OUR) & (F.col("outcome") == "signed") & (F.col("direction") == "worse"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("taxonomy_id").orderBy(size, "ord")))


def acceptable(observations: DataFrame) -> DataFrame:
    """Signed neutral variants, one for each text of a taxonomy, those on own paper first."""
    every = counted(observations)
    kept = every.where((F.col("outcome") == "signed") & (F.col("direction") == "neutral") & (F.col("deviation") != "none") & _judged())
    ours_first = F.when(F.col("provenance") == OUR, 0).otherwise(1)
    others = [c for c in observations.columns if c not in ("taxonomy_id", "full_text")]
    first = kept.groupBy("taxonomy_id", "full_text").agg(F.min_by(F.struct(*others), F.struct(ours_first, "ord")).alias("x")).select("taxonomy_id", "full_text", "x.*")
    c = _text_counts(every).select(F.col("taxonomy_id").alias("__t"), F.col("full_text").alias("__x"), "precedent_count")
    told = first.join(c, (F.col("taxonomy_id") == F.col("__t")) & F.col("full_text").eqNullSafe(F.col("__x"))).drop("__t", "__x")
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("taxonomy_id").orderBy(ours_first, "ord")))


def library(observations: DataFrame) -> DataFrame:
    """Accepted forms of each taxonomy: signed observations, how many are on counterparty paper, distinct texts in order."""
    signed = observations.where(F.col("taxonomy_id").isNotNull() & (F.col("outcome") == "signed"))
    texts = signed.groupBy("taxonomy_id", "full_text").agg(F.count("*").alias("n"), F.count_if(F.col("provenance") == THEIR).alias("theirs"))
    return texts.groupBy("taxonomy_id").agg(F.sum("n").cast("bigint").alias("n_forms"), F.sum("theirs").cast("bigint").alias("n_counterparty_paper"), F.array_sort(F.collect_list("full_text")).alias("forms"))


def preferred_variations(entries: DataFrame, top: int = 5) -> DataFrame:
    """The digest's variations: of each taxonomy's entries (taxonomy_id, if_text, to_text, precedent_count, material, ord), grouped by both texts
    whatever case and marks, the ``top`` most frequent and every material one, represented by their most frequent entry, the first on ties."""
    e = entries.withColumn("n1", F.coalesce("precedent_count", F.lit(1))).withColumn("form", normalize(F.concat_ws(" ", "if_text", "to_text"))).where("form <> ''")
    best = F.struct(-F.col("n1"), "ord")
    g = e.groupBy("taxonomy_id", "form").agg(F.sum("n1").cast("bigint").alias("n"), F.bool_or("material").alias("material"), F.min("ord").alias("first_seen"), F.min_by("if_text", best).alias("if_text"), F.min_by("to_text", best).alias("to_text"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("taxonomy_id").orderBy(F.desc("n"), "first_seen")))
    return ranked.where((F.col("rank") <= top) | F.col("material")).withColumn("band", band(F.col("n")))


def ranked_forms(observations: DataFrame, key: Column, top: int = 5) -> DataFrame:
    """The digest's size rule: of each taxonomy's texts, grouped by ``key``, the ``top`` most frequent and every material one.

    ``observations`` has taxonomy_id, full_text, precedent_count, material and ord; the representative is the last material
    member or else the first.
    """
    g = observations.withColumn("form", key).where("form <> ''").groupBy("taxonomy_id", "form").agg(
        F.sum(F.coalesce(F.col("precedent_count"), F.lit(1))).cast("bigint").alias("n"), F.bool_or("material").alias("material"), F.min("ord").alias("first_seen"),
        F.coalesce(F.max_by("full_text", F.when(F.col("material"), F.col("ord"))), F.min_by("full_text", "ord")).alias("representative"),
    )
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("taxonomy_id").orderBy(F.desc("n"), "first_seen")))
    return ranked.where((F.col("rank") <= top) | F.col("material")).withColumn("band", band(F.col("n")))


def reversal_candidates(observations: DataFrame, min_deals: int = 2, structural: tuple[str, ...] = ()) -> DataFrame:
    """Taxonomies whose proposals were reversed in at least ``min_deals`` documents, structural ones left out."""
    r = observations.where((F.col("outcome") == "proposed_then_reversed") & F.col("taxonomy_id").isNotNull())
    if structural:
        r = r.where(~F.col("taxonomy_id").isin(*structural))
    g = r.groupBy("taxonomy_id").agg(F.count_distinct("document_id").alias("n_deals"), F.count("*").alias("n_reversals"), F.count_distinct("document_id", "version", "clause_path").alias("n_citations"))
    return g.where(F.col("n_deals") >= min_deals).withColumn("candidate_id", F.format_string("cand-%03d", F.row_number().over(Window.orderBy("taxonomy_id")).cast("int")))


def omitted_reversals(observations: DataFrame, min_deals: int = 2, structural: tuple[str, ...] = ()) -> DataFrame:
    """Reversals that give no candidate: unclassified, structural, or in too few documents."""
    r = observations.where(F.col("outcome") == "proposed_then_reversed")
    deals = r.groupBy("taxonomy_id").agg(F.count_distinct("document_id").alias("deals"), F.count("*").alias("n"))
    is_structural = F.col("taxonomy_id").isin(*structural) if structural else F.lit(False)
    known = F.col("taxonomy_id").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return deals.agg(total(~known).alias("unclassified"), total(known & is_structural).alias("structural"), total(known & ~is_structural & (F.col("deals") < min_deals)).alias("below_min_deals"))
