"""Versions of one agreement: alignment of clauses, diffs, reversals, rounds, order and shape.

Clauses are rows (document_id, version_ord from 1, alignment, text); alignment identifies the same clause across versions.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_ops import all_words, jaccard, normalize, words
from .graph import connected_components
from .similarity import greedy_matching, similar_pairs

HUNKS = "array<struct<kind:string,old_text:string,new_text:string>>"
EXACT_CHARS, JACCARD, JACCARD_WORDS = 30, 0.80, 8
EXHAUSTIVE, TIE = 8, 1e-9


def _paired(clauses: DataFrame) -> DataFrame:
    """Clauses with ``j``, the place in the next version of the one with an equal normalised text of at least 30 characters, the kth to the kth, and
    ``was``, whether the version before has one. Texts are told apart by their digests, and one shuffle by document serves all windows.
    """
    norm = normalize(F.col("text"))
    told = F.when(F.length(norm) >= EXACT_CHARS, F.md5(norm)).otherwise(F.concat_ws("-", "version_ord", "ord"))  # no digest is as short as what makes a clause its own
    c = clauses.where("document_id is not null").withColumn("told", told).repartition("document_id")
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("document_id", "version_ord", "told").orderBy("ord")))
    same = Window.partitionBy("document_id", "told", "k").orderBy("version_ord")
    next_, last = F.lead(F.struct("version_ord", "ord")).over(same), F.lag("version_ord").over(same)
    c = c.withColumn("next", next_).withColumn("was", F.coalesce(last == F.col("version_ord") - 1, F.lit(False)))
    return c.withColumn("j", F.when(F.col("next.version_ord") == F.col("version_ord") + 1, F.col("next.ord"))).drop("next", "k", "told")


def exact_moves(clauses: DataFrame) -> DataFrame:
    """(document_id, version_ord, i, j): clauses of consecutive versions with equal normalised texts of at least 30 characters, the kth to the kth.

    ``clauses`` has document_id, version_ord, ord and text.
    """
    return _paired(clauses.select("document_id", "version_ord", "ord", "text")).where("j is not null").select("document_id", "version_ord", F.col("ord").alias("i"), "j")


def moves(clauses: DataFrame, checkpoint: Callable) -> DataFrame:
    """Exact moves, and on what is left the greedy one-to-one matches with a Jaccard similarity of at least 0.8 over 8 words."""
    doc = Window.partitionBy("document_id")
    paired = _paired(clauses.select("document_id", "version_ord", "ord", "text")).withColumn("low", F.min("version_ord").over(doc)).withColumn("high", F.max("version_ord").over(doc))
    a = F.when(F.col("j").isNull() & (F.col("version_ord") < F.col("high")), F.struct(F.col("version_ord"), F.lit(0).alias("side")))
    b = F.when(~F.col("was") & (F.col("version_ord") > F.col("low")), F.struct((F.col("version_ord") - 1).alias("version_ord"), F.lit(1).alias("side")))
    paired = paired.withColumn("sides", F.array_compact(F.array(a, b))).withColumn("words", F.when(F.size("sides") > 0, words(F.col("text"))))
    paired = paired.withColumn("words", F.when(F.size("words") >= JACCARD_WORDS, F.transform("words", lambda w: F.xxhash64(w))))
    paired = checkpoint(paired.where("j is not null or words is not null").select("document_id", "version_ord", "ord", "j", "sides", "words"))
    exact = paired.where("j is not null").select("document_id", "version_ord", F.col("ord").alias("i"), "j")
    both = paired.where("words is not null").select("document_id", "ord", "words", F.explode("sides").alias("s")).select("document_id", "s.version_ord", "s.side", "ord", "words")
    both = both.withColumn("key", F.struct("document_id", "version_ord", "side", "ord")).withColumn("group", F.struct("document_id", "version_ord"))
    near = similar_pairs(both, JACCARD, group="group", checkpoint=checkpoint).where("a.side = 0 and b.side = 1")
    edges = near.select(F.struct(F.col("a.document_id"), F.col("a.version_ord")).alias("group"), F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), "similarity")
    fuzzy = greedy_matching(edges, checkpoint).select("group.document_id", "group.version_ord", "i", "j", F.lit("content_jaccard").alias("basis"), "similarity")
    return exact.withColumn("basis", F.lit("content_exact")).withColumn("similarity", F.lit(1.0)).unionByName(fuzzy)


def chains(matched: DataFrame, clauses: DataFrame, checkpoint: Callable) -> DataFrame:
    """Clauses with the alignment that the matches of consecutive versions chain them to, its confidence and basis.

    The alignment is the smallest hash of its clauses; a clause without a match is a chain of its own.
    """
    node = lambda v, o: F.xxhash64("document_id", v, o)
    links = matched.select(node(F.col("version_ord").cast("bigint"), F.col("i").cast("bigint")).alias("u"), node((F.col("version_ord") + 1).cast("bigint"), F.col("j").cast("bigint")).alias("v"), "similarity", "basis")
    links = checkpoint(links)
    roots = connected_components(links.select("u", "v"), checkpoint)
    score = links.join(roots, links.u == roots.node).groupBy("root").agg(F.min("similarity").alias("confidence"), F.bool_and(F.col("basis") == "content_exact").alias("exact"))
    told = roots.join(score, "root")
    named = clauses.withColumn("node", node(F.col("version_ord").cast("bigint"), F.col("ord").cast("bigint")))
    out = named.join(told, "node", "left").withColumn("alignment", F.coalesce("root", "node"))
    return out.select(*clauses.columns, "alignment", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.when(F.col("exact").isNull(), "none").when(F.col("exact"), "content_exact").otherwise("content_jaccard").alias("match_basis"))


def _kinds(rows: DataFrame) -> DataFrame:
    kind = F.when(~F.col("had"), "added").when(~F.col("has"), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return rows.withColumn("kind", kind)


def consecutive_diff(clauses: DataFrame) -> DataFrame:
    """For each clause and round (from version ``round`` to the next): before, after and kind.

    One aggregation: each clause is the after of one round and the before of the next, so no self-join is needed.
    """
    last = F.max("version_ord").over(Window.partitionBy("document_id"))
    c = clauses.withColumn("last", last)
    sides = c.select("document_id", "alignment", "last", F.explode(F.array(F.struct(F.col("version_ord").alias("round"), F.lit(0).alias("side"), "text"), F.struct((F.col("version_ord") - 1).alias("round"), F.lit(1).alias("side"), "text"))).alias("x"))
    sides = sides.select("document_id", "alignment", "last", "x.*").where("round >= 1 and round < last")
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("text")))
    g = sides.groupBy("document_id", "alignment", "round").agg(pick(0).alias("before"), pick(1).alias("after"), F.bool_or(F.col("side") == 0).alias("had"), F.bool_or(F.col("side") == 1).alias("has"))
    return _kinds(g).select("document_id", "alignment", "round", "before", "after", "kind")


def net_diff(clauses: DataFrame) -> DataFrame:
    """For each clause, the first version against the last."""
    doc = Window.partitionBy("document_id")
    c = clauses.withColumn("low", F.min("version_ord").over(doc)).withColumn("high", F.max("version_ord").over(doc)).where("low < high")
    is_low, is_high = F.col("version_ord") == F.col("low"), F.col("version_ord") == F.col("high")
    g = c.groupBy("document_id", "alignment").agg(F.max(F.when(is_low, F.col("text"))).alias("before"), F.max(F.when(is_high, F.col("text"))).alias("after"), F.bool_or(is_low).alias("had"), F.bool_or(is_high).alias("has"))
    return _kinds(g.where("had or has")).select("document_id", "alignment", "before", "after", "kind")


def word_hunks(before: str | None, after: str | None) -> list[tuple[str, str, str]]:
    """(kind, old_text, new_text) of the words that differ, in order."""
    a, b = (re.sub(r"\s+", " ", x or "").strip().split(" ") if x and x.strip() else [] for x in (before, after))
    ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [(kind, " ".join(a[i:j]), " ".join(b[k:n])) for kind, i, j, k, n in ops if kind != "equal"]


def _hunk_series(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "old_text": o, "new_text": n} for k, o, n in word_hunks(x, y)] for x, y in zip(before, after)], dtype=object)


def with_hunks(diffs: DataFrame) -> DataFrame:
    """Diffs with the word hunks of modified clauses; only those pass through Python."""
    hunks = F.pandas_udf(_hunk_series, HUNKS)
    changed = diffs.where("kind = 'modified'").withColumn("hunks", hunks("before", "after"))
    return changed.unionByName(diffs.where("kind <> 'modified'").withColumn("hunks", F.array().cast(HUNKS)))


def reversals(diffs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Rounds whose inserted words aren't all among the signed version's words of the same clause.

    ``diffs`` are consecutive ones with hunks; the signed version is the last.
    """
    net = Window.partitionBy("document_id")
    signed = clauses.withColumn("high", F.max("version_ord").over(net)).where("version_ord = high").select("document_id", "alignment", words(F.col("text")).alias("signed"))
    inserted = F.filter("hunks", lambda h: h["kind"].isin("insert", "replace") & (h["new_text"] != ""))
    text = F.when(F.col("kind") == "added", F.col("after")).otherwise(F.array_join(F.transform(inserted, lambda h: h["new_text"]), " "))
    proposed = diffs.where("kind in ('added', 'modified')").withColumn("proposed_text", text).withColumn("proposed", words(F.col("proposed_text"))).where(F.size("proposed") > 0)
    joined = proposed.join(signed, ["document_id", "alignment"], "left").withColumn("signed", F.coalesce("signed", F.array().cast("array<string>")))
    lost = F.array_except("proposed", "signed")
    return joined.where(F.size(lost) > 0).select("document_id", "alignment", "round", "kind", "proposed_text", F.array_sort(lost).alias("lost_words"))


def set_reversals(diffs: DataFrame, clauses: DataFrame) -> DataFrame:
    """The same without hunks: words new in a round that the signed version lacks. Fewer than ``reversals``, never others."""
    net = Window.partitionBy("document_id")
    signed = clauses.withColumn("high", F.max("version_ord").over(net)).where("version_ord = high").select("document_id", "alignment", words(F.col("text")).alias("signed"))
    new = F.array_except(words(F.col("after")), words(F.col("before")))
    joined = diffs.where("kind in ('added', 'modified')").withColumn("new", new).join(signed, ["document_id", "alignment"], "left")
    return joined.withColumn("lost", F.size(F.array_except("new", F.coalesce("signed", F.array().cast("array<string>"))))).where("lost > 0").select("document_id", "alignment", "round", "lost")


def round_moves(diffs: DataFrame) -> DataFrame:
    """The changed diffs numbered within their round, with a summary of at most 200 characters."""
    summary = F.when(F.col("kind") == "added", F.concat(F.lit("added: "), F.col("after"))).when(F.col("kind") == "removed", F.concat(F.lit("removed: "), F.col("before"))).otherwise(F.concat(F.lit("modified: "), F.col("after")))
    turn = F.row_number().over(Window.partitionBy("document_id", "round").orderBy("alignment"))
    return diffs.where("kind <> 'unchanged'").select("document_id", "round", "alignment", "kind", turn.alias("move"), F.substring(summary, 1, 200).alias("change_summary"))


def numbered(observations: DataFrame, base: str, order: str) -> DataFrame:
    """observation_id: the base id, with #n from the second that has it on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return observations.withColumn("n", n).withColumn("observation_id", F.when(F.col("n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), F.col("n").cast("string")))).drop("n")


def deviations(diffs: DataFrame, standards: DataFrame | None = None, same: float = 0.92) -> DataFrame:
    """deviation and basis of diffs with a taxonomy_id: none where the text is the standard's or nearly its own before, else to judge."""
    if standards is not None:
        diffs = diffs.join(standards.select("taxonomy_id", "our_standard"), "taxonomy_id", "left")
    else:
        diffs = diffs.withColumn("our_standard", F.lit(None).cast("string"))
    near = jaccard(all_words(F.col("after")), all_words(F.when(F.col("kind") == "unchanged", F.col("our_standard")).otherwise(F.col("before"))))
    alike = F.when(F.col("kind") == "unchanged", F.col("our_standard").isNull() | (near >= same)).when(F.col("kind") == "modified", near >= same).otherwise(F.lit(False))
    return diffs.withColumn("basis", F.when(alike & (F.col("kind") == "unchanged"), "unchanged").when(alike, "reworded").otherwise("pending")).withColumn("deviation", F.when(alike, "none"))


def line_ratio(a: list[str], b: list[str]) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _chain(names: list, signed, dist: Callable, score: Callable | None = None) -> tuple[list, str, list]:
    """(order, basis, terminals): the cheapest order of the unsigned versions with the signed one last.

    All orders up to 8 are tried; of equally cheap ones the best by ``score`` wins, then the first, and the basis is hints where the
    score moved the choice. More are taken from the farthest to the nearest next. ``terminals`` are the versions that could be last at the least cost.
    """
    free = sorted(n for n in names if n != signed)
    tail = [signed] if signed is not None else []
    if len(names) == 1:
        return list(names), "single", list(names)
    cost = lambda c: sum(dist(x, y) for x, y in itertools.pairwise(c))
    if len(free) <= EXHAUSTIVE:
        best, least, by_hints, last = None, float("inf"), False, set()
        for order in itertools.permutations(free):
            c = [*order, *tail]
            now = cost(c)
            if now < least - TIE:
                best, least, by_hints, last = c, now, False, {c[-1]}
            elif now <= least + TIE:
                last.add(c[-1])
                if score and score(c) > score(best):
                    best, by_hints = c, True
        return best, "hints" if by_hints else "exhaustive", sorted(last)
    far = lambda n: dist(n, signed) if signed is not None else sum(dist(n, m) for m in free if m != n) / max(1, len(free) - 1)
    at = min(free, key=lambda n: (-round(far(n), 9), n))
    out, rest = [at], set(free) - {at}
    while rest:
        at = min(rest, key=lambda n: (round(dist(out[-1], n), 9), n))
        out.append(at)
        rest.discard(at)
    return out + tail, "greedy", (out + tail)[-1:]


def hint_score(chain: list, times: dict, places: dict) -> float:
    """One for each step of a chain that agrees with the times, and with the places in an order that was given; one less for each that doesn't."""
    score = 0.0
    for a, b in itertools.pairwise(chain):
        if times.get(a) and times.get(b):
            score += 1.0 if times[a] <= times[b] else -1.0
        if a in places and b in places:
            score += 1.0 if places[a] < places[b] else -1.0
    return score


def with_hints(versions: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Versions (document_id, version, text, signed, and name and timestamp where known) with hint_time and hint_place.

    ``hints`` (document_id, version_order, timestamps) go before a version's own timestamp, for each version by its name.
    """
    name = F.col("name") if "name" in versions.columns else F.col("version").cast("string")
    own = F.col("timestamp") if "timestamp" in versions.columns else F.lit(None).cast("string")
    if hints is None:
        return versions.withColumn("hint_time", own).withColumn("hint_place", F.lit(None).cast("int"))
    both = versions.join(hints.select("document_id", "version_order", "timestamps"), "document_id", "left")
    place = F.nullif(F.array_position("version_order", name), F.lit(0))
    return both.withColumn("hint_time", F.coalesce(F.try_element_at("timestamps", name), own)).withColumn("hint_place", place.cast("int")).drop("version_order", "timestamps")


def chain_shape(steps: list[float], gap: float = 0.4) -> str:
    """gap where a step is above 0.4, fork where the largest is at least twice the upper median, else linear."""
    if not steps:
        return "linear"
    ordered = sorted(steps)
    if ordered[-1] > gap:
        return "gap"
    median = ordered[len(ordered) // 2]
    return "fork" if len(ordered) > 1 and median > 0 and ordered[-1] >= 2 * median and ordered[-1] != median else "linear"


def shapes(steps: DataFrame, key: str, gap: float = 0.4) -> DataFrame:
    """(key, largest, upper_median, shape) of rows (key, step); the same rule as ``chain_shape``, one aggregation."""
    s = steps.where("step IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list("step")).alias("s"))
    s = s.select(key, "s", F.element_at("s", -1).alias("largest"), F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("upper_median"))
    median = F.col("upper_median")
    fork = (F.size("s") > 1) & (median > 0) & (F.col("largest") >= 2 * median) & (F.col("largest") != median)
    return s.withColumn("shape", F.when(F.col("largest") > gap, "gap").when(fork, "fork").otherwise("linear")).drop("s")


def _order_document(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("version")
    texts = {v: [x for x in map(str.strip, (t or "").split("\n")) if x] for v, t in zip(rows["version"], rows["text"])}
    held = {(a, b): 1 - line_ratio(texts[a], texts[b]) for a, b in itertools.combinations(rows["version"], 2)}
    dist = lambda a, b: held[(a, b)] if (a, b) in held else held[(b, a)]
    signed = rows.loc[rows["signed"], "version"]
    times = {v: t for v, t in zip(rows["version"], rows["hint_time"]) if isinstance(t, str) and t}
    places = {v: int(p) for v, p in zip(rows["version"], rows["hint_place"]) if pd.notna(p)}
    score = (lambda c: hint_score(c, times, places)) if times or places else None
    names = list(rows["version"])
    chain, basis, terminals = _chain(names, signed.iloc[-1] if len(signed) else None, dist, score)
    steps = [dist(a, b) for a, b in itertools.pairwise(chain)]
    return pd.DataFrame({
        "document_id": rows["document_id"].iloc[0], "version": chain, "version_ord": range(1, len(chain) + 1), "step": [None, *steps], "total_distance": sum(steps), "shape": chain_shape(steps),
        "basis": basis, "terminals": [[int(t) for t in terminals]] * len(chain),
    })


ORDERED = "document_id bigint, version bigint, version_ord int, step double, total_distance double, shape string, basis string, terminals array<bigint>"


def order_versions(versions: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(document_id, version, version_ord, step, total_distance, shape, basis, terminals) of (document_id, version, text, signed), a task a document.

    basis is single, exhaustive, hints or greedy. See ``with_hints`` for hints and timestamps.
    """
    return with_hints(versions, hints).groupBy("document_id").applyInPandas(_order_document, ORDERED)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    cut = lambda t: [x for x in map(str.strip, (t or "").split("\n")) if x]
    return pd.Series([1 - line_ratio(cut(x), cut(y)) for x, y in zip(a, b)], dtype="float64")


def pairwise_distances(versions: DataFrame) -> DataFrame:
    """Distance of each pair of versions of a document, from the earlier to the later."""
    other = versions.select("document_id", F.col("version").alias("other"), F.col("text").alias("other_text"))
    pairs = versions.join(other, "document_id").where("version < other")
    return pairs.select("document_id", "version", "other", F.pandas_udf(_ratios, "double")("text", "other_text").alias("distance"))


def representative(versions: DataFrame) -> DataFrame:
    """One version a document, with the basis of the choice: the signed one of the highest confidence, of equals the last by natural key.

    Without a signed one, that of ``terminals`` (those that could end the cheapest chain, where the column is there) if it is one, else the last
    of them by natural key. A document's only version has the basis single.
    """
    one = Window.partitionBy("document_id")
    could = F.array_contains("terminals", F.col("version")) if "terminals" in versions.columns else F.lit(True)
    order = one.orderBy(F.when(F.col("signed"), 0).when(could, 1).otherwise(2), F.when(F.col("signed"), -F.col("confidence")), F.desc("natural_key"))
    alone = (F.size("terminals") == 1) if "terminals" in versions.columns else F.lit(False)
    basis = F.when(F.count("*").over(one) == 1, "single").when(F.col("signed"), "signed").when(alone, "chain_terminal").otherwise("filename_tiebreak")
    return versions.withColumn("turn", F.row_number().over(order)).withColumn("basis", basis).where("turn = 1").drop("turn")


def template_similarity(documents: DataFrame, template: str, text: str = "text") -> DataFrame:
    """``documents`` with ``similarity``: how much of their lines, in order, are the template's."""
    lines = [x for x in map(str.strip, template.split("\n")) if x]

    def ratios(texts: pd.Series) -> pd.Series:
        cut = lambda t: [x for x in map(str.strip, (t or "").split("\n")) if x]
        return pd.Series([line_ratio(lines, cut(t)) if lines and cut(t) else float(not lines and not cut(t)) for t in texts], dtype="float64")

    return documents.withColumn("similarity", F.pandas_udf(ratios, "double")(F.col(text)))


def attribute_hunks(hunks: DataFrame, changes: DataFrame, checkpoint: Callable, least: float = 0.5) -> DataFrame:
    """Tracked changes matched to hunks of the same kind whose clause is the same or whose spans overlap, one to one, from a similarity of 0.5.

    hunks: document_id, hunk, clause_path, start, end, kind, text; changes: document_id, change, the same and author.
    """
    c = changes.select("document_id", "change", F.col("clause_path").alias("path2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("kind").alias("kind2"), F.col("text").alias("text2"), "author")
    near = hunks.join(c, "document_id").where((F.col("kind") == F.col("kind2")) & ((F.col("clause_path") == F.col("path2")) | ((F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end")))))
    scored = near.withColumn("similarity", jaccard(words(F.col("text")), words(F.col("text2")))).where(F.col("similarity") >= least)
    edges = scored.select(F.col("document_id").alias("group"), F.col("hunk").alias("i"), F.col("change").alias("j"), "similarity")
    won = greedy_matching(edges, checkpoint).select(F.col("group").alias("document_id"), F.col("i").alias("hunk"), F.col("j").alias("change"), "similarity")
    return won.join(changes.select("document_id", "change", "author"), ["document_id", "change"])
