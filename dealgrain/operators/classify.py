"""Classifiers that are ladders of rules, and taxonomy induction from headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_ops import entry_id, heading_words, normalize, title, words
from .similarity import best_match, leaders, overlapping_pairs

AUTO, AMBIGUOUS = 0.85, 0.70


def _phrase(*said: str) -> str:
    """Any of some phrases, whatever is blank between their words."""
    return "(?:" + "|".join(r"[ \t\r\n]+".join(x.split()) for x in said) + ")"


UUID = "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
CERTIFICATE = f"(?is)({_phrase('docusign envelope id')}[ ]*:[ ]*{UUID}|{_phrase('certificate of completion', 'electronically signed by')}[ \\n].*[ \\n]docusign)"
PLATFORM = rf"(?i)\b{_phrase('hellosign', 'docusign', 'adobe sign')}\b"
TRAILER = rf"(?i)\b{_phrase('executed as a deed', 'in witness whereof')}\b"
HEADING = r"(?im)^[ \t]*(execution|signatures?)[ \t]*$"
BY = r"(?im)(?:\||^)[ \t]*By[ \t]*:[ \t]*([^|\r\n]*)"
SLASH = "/s/[ ]+[^ ]"
BLANK = "^[-_ \\t–—]*$"


def signed_features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    by = F.regexp_extract_all(t, F.lit(BY), 1)
    blank = F.size(F.filter(by, lambda x: x.rlike(BLANK)))
    return {
        "certificate": t.rlike(CERTIFICATE), "platform": t.rlike(PLATFORM), "heading": t.rlike(HEADING), "trailer": t.rlike(TRAILER),
        "filled": (F.size(by) - blank).cast("int"), "blank": blank.cast("int"), "slashes": F.regexp_count(t, F.lit(SLASH)).cast("int"),
    }


def signed_status(documents: DataFrame, text: str = "text") -> DataFrame:
    """signed, basis and confidence of whole texts: certificate, signatures counted in a signature section, blanks, trailers, none."""
    f = documents.withColumns({f"__{k}": v for k, v in signed_features(F.col(text)).items()})
    cert, plat, head, trail, filled, blank, slash = (F.col(f"__{k}") for k in ("certificate", "platform", "heading", "trailer", "filled", "blank", "slashes"))
    section = head | trail
    ladder = [
        (cert, True, "docusign_certificate", 0.95), (~section & (slash >= 2), True, "dual_signatures", 0.85), (~section & (slash == 1), True, "electronic_signature", 0.65),
        (~section & plat, True, "electronic_signature", 0.65), (~section, False, "no_signature_section", 0.85), (filled + slash >= 2, True, "dual_signatures", 0.90),
        (filled == 1, True, "single_signature", 0.75), (slash == 1, True, "electronic_signature", 0.80), (blank > 0, False, "blank_signature_blocks", 0.80), (head, False, "empty_signature_section", 0.60),
    ]

    def pick(k: int, last) -> Column:
        c = F.when(ladder[0][0], F.lit(ladder[0][k]))
        for row in ladder[1:]:
            c = c.when(row[0], F.lit(row[k]))
        return c.otherwise(F.lit(last))

    out = f.withColumns({"signed": pick(1, False), "basis": pick(2, "unsigned_trailer_reference"), "confidence": pick(3, 0.80)})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def provenance(documents: DataFrame, aliases: list[str], text: str = "text", similarity: str | None = None) -> DataFrame:
    """provenance, basis and confidence: likeness to the template, else which party an alias is in the recital, else its presence."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    opening = F.substring(t, 1, 1000)
    first, second = (F.regexp_extract(opening, r"between\s+(.{1,200}?)\s+and\s+(.{1,200}?)(?:[.,;(]|$)", k) for k in (1, 2))
    any_of = lambda c: F.lit(False) if not aliases else _or([c.rlike(rf"\b\Q{a.lower()}\E\b") for a in aliases])
    sim = F.col(similarity) if similarity else F.lit(None).cast("double")
    rungs = [
        (F.lit(not aliases), "counterparty_paper", "no_aliases_configured", F.lit(0.50)), (sim >= 0.60, "our_paper", "template_similarity", F.least(F.lit(0.95), 0.70 + 0.25 * (sim - 0.60) / 0.40)),
        (sim <= 0.40, "counterparty_paper", "template_similarity", F.lit(0.60)), (any_of(first), "our_paper", "alias_first_party", F.lit(0.85)), (any_of(second), "counterparty_paper", "alias_second_party", F.lit(0.75)),
        (any_of(t), "our_paper", "alias_present", F.lit(0.65)),
    ]

    def pick(k: int, last) -> Column:
        value = lambda r: r[k] if isinstance(r[k], Column) else F.lit(r[k])
        c = F.when(F.coalesce(rungs[0][0], F.lit(False)), value(rungs[0]))
        for r in rungs[1:]:
            c = c.when(F.coalesce(r[0], F.lit(False)), value(r))
        return c.otherwise(F.lit(last))

    return documents.withColumns({"provenance": pick(1, "counterparty_paper"), "basis": pick(2, "alias_absent"), "confidence": pick(3, 0.65)})


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def classify(clauses: DataFrame, taxonomy: DataFrame, verdicts: DataFrame | None = None, auto: float = AUTO, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """taxonomy_id, basis and confidence of (clause, heading, text): equal headings, else the most similar label from ``auto`` on, else, from ``ambiguous`` on, a verdict.

    ``taxonomy`` has id, label, ord and status; only active and custom entries count. ``verdicts`` has clause and verdict_id.
    """
    live = taxonomy.where(F.col("status").isin("active", "custom"))
    exact = live.groupBy(normalize(F.col("label")).alias("norm")).agg(F.min_by("id", "ord").alias("exact_id"))
    c = clauses.withColumn("norm", normalize(F.col("heading"))).join(exact, "norm", "left")
    near = best_match(c.where("exact_id is null and norm <> ''").select("clause", words(F.col("heading")).alias("words")), live.select("id", "ord", words(F.col("label")).alias("ref_words")), "clause", "id", "ord")
    c = c.join(near.select("clause", F.col("id").alias("near_id"), "similarity"), "clause", "left")
    if verdicts is not None:
        c = c.join(verdicts.select("clause", "verdict_id"), "clause", "left").join(live.select(F.col("id").alias("verdict_id"), F.lit(True).alias("known")), "verdict_id", "left")
    else:
        c = c.withColumn("verdict_id", F.lit(None).cast("string")).withColumn("known", F.lit(None).cast("boolean"))
    empty = (F.col("norm") == "") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    judged = (F.col("norm") == "") | (F.col("similarity") >= ambiguous)
    basis = F.when(F.col("exact_id").isNotNull(), "heading_exact").when(F.col("similarity") >= auto, "heading_similarity").when(empty, "empty").when(judged & F.col("known"), "judge").when(judged, "pending").otherwise("unclassified")
    return c.withColumn("basis", basis).select(
        *clauses.columns, F.when(basis == "heading_exact", F.col("exact_id")).when(basis == "heading_similarity", F.col("near_id")).when(basis == "judge", F.col("verdict_id")).alias("taxonomy_id"), "basis",
        F.when(basis == "heading_exact", 1.0).when(basis == "heading_similarity", F.col("similarity")).alias("confidence"),
    )


def induce(headings: DataFrame, checkpoint: Callable, share: float = 0.20, near: float = 0.5, known: DataFrame | None = None, match: float = 0.60) -> DataFrame:
    """A taxonomy from (document_id, heading): leader clusters of headings alike by overlap, their share of documents, and status.

    Headings are taken in alphabetical order of their normal form. A cluster in at least ``share`` of the documents is active where it matches an
    entry of ``known`` (id, label, ord) with a Jaccard similarity of at least ``match``, custom where it doesn't; others are inactive.
    """
    h = checkpoint(headings.withColumn("norm", normalize(F.col("heading"))).where("norm <> ''").select("document_id", "norm").distinct())
    total = h.select("document_id").distinct().count()
    forms = h.select("norm").distinct().orderBy("norm").select("norm", F.monotonically_increasing_id().alias("node"))
    forms = checkpoint(forms.withColumn("words", heading_words(F.col("norm"))))
    led = checkpoint(leaders(overlapping_pairs(forms, near, "node", "words", checkpoint), forms.select("node"), checkpoint).select("node", F.col("leader").alias("led_by")))
    of = h.join(forms.select("norm", "node"), "norm").join(led, "node").select("led_by", "document_id").distinct().groupBy("led_by").agg(F.count("*").alias("documents"))
    g = of.join(led.groupBy("led_by").agg(F.count("*").alias("forms")), "led_by").join(forms.select(F.col("node").alias("led_by"), F.col("norm").alias("leader")), "led_by").drop("led_by")
    g = g.withColumn("frequency", F.col("documents") / F.lit(max(total, 1)))
    if known is not None:
        best = best_match(g.select("leader", words(F.col("leader")).alias("words")), known.select(F.col("id").alias("origin"), "ord", words(F.col("label")).alias("ref_words")), "leader", "origin", "ord", match)
        g = g.join(best.select("leader", "origin"), "leader", "left")
    else:
        g = g.withColumn("origin", F.lit(None).cast("string"))
    base = entry_id(F.col("leader"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("leader"))
    named = g.withColumn("base", base).withColumn("n", n)
    status = F.when(F.col("frequency") < share, "inactive").when(F.col("origin").isNotNull(), "active").otherwise("custom")
    return named.select(F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))).alias("id"), title(F.col("leader")).alias("label"), "leader", "documents", "forms", "frequency", "origin", status.alias("status"))
