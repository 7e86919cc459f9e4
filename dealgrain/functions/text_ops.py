"""Text expressions: five tokenisers that must not be unified, similarities, keys, slugs, snippets and dates.

All are Column -> Column and stay in generated code. Letters and digits are the Unicode classes, as Java's own ``\\w`` is
ASCII alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("with from that this the and are for an as at be by in is it of on or to a".split())
HEADING_STOP_WORDS = tuple(w for w in STOP_WORDS if w != "on")
_GAP = r"[^\p{L}\p{N}_]+"
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁠⁦⁧⁨⁩﻿"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Lower case, marks as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), _GAP, " "))


def word_list(c: Column) -> Column:
    """Words in order, repeats and stop words included."""
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def words(c: Column) -> Column:
    """Set of words without stop words, for alignment, classification and overlays."""
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def all_words(c: Column) -> Column:
    """Set of words with stop words, for deviations."""
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda w: w != ""))


def heading_words(c: Column) -> Column:
    """Set of words without the shorter list of stop words, for headings."""
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda w: (w != "") & ~w.isin(*HEADING_STOP_WORDS)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over all members of two sets."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(shared / every)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over those of the smaller set; 0 for an empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / least)


def dedup_key(c: Column) -> Column:
    """Lower case with blanks collapsed, marks kept: what counts as one precedent."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"[ \t\r\n]+", " "))


def slug(c: Column, fallback: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def entry_id(c: Column, longest: int = 60) -> Column:
    """snake_case identifier of a heading."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(s, 1, longest)


def title(c: Column) -> Column:
    """An identifier as a title."""
    return F.initcap(F.regexp_replace(F.regexp_replace(c, r"^.*\.", ""), "[_-]+", " "))


def natural_key(c: Column, width: int = 12) -> Column:
    """A sort key with v2 before v10: runs of digits padded with zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, width, "0")).otherwise(x)), "")


def snippet(c: Column, limit: int = 100) -> Column:
    """First line that isn't blank, cut at the last blank before the limit if there is one."""
    line = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text_or_empty(c), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit(""))
    head = F.substring(line, 1, limit)
    back = F.locate(" ", F.reverse(head))
    cut = F.when(back > 0, F.substring(head, F.lit(1), limit - back)).otherwise(head)
    return F.when(F.length(line) <= limit, line).otherwise(F.rtrim(cut))


def quarter(c: Column) -> Column:
    """2024-05-01 as 2024-Q2."""
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def band(n: Column) -> Column:
    return F.when(n >= 10, "often").when(n >= 2, "sometimes").otherwise("rare")


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def has_invisible(c: Column) -> Column:
    return F.length(c) != F.length(F.translate(c, INVISIBLE, ""))


def version_number(c: Column) -> Column:
    """v3 or 3 as 3; null for anything else."""
    return F.regexp_replace(F.lower(c), "^v", "").try_cast("int")


def looks_signed(stem: Column) -> Column:
    """A file stem says signed or executed and doesn't deny it."""
    tokens = F.split(F.lower(text_or_empty(stem)), "[^a-z0-9]+")
    return F.arrays_overlap(tokens, F.array(F.lit("signed"), F.lit("executed"))) & ~F.arrays_overlap(tokens, F.array(*map(F.lit, ("unsigned", "unexecuted", "not", "non", "for", "tobe"))))


def party_side(author: Column, aliases: list[str]) -> Column:
    """us when the author contains an alias or the reverse, counterparty for any other author, unknown for none."""
    name = F.lower(F.trim(text_or_empty(author)))
    ours = F.lit(False)
    for a in aliases:
        ours = ours | name.contains(a.lower()) | F.lit(a.lower()).contains(name)
    return F.when(name == "", "unknown").when(ours, "us").otherwise("counterparty")


def window_text(c: Column, before: str = "[BEFORE]", after: str = "[AFTER]") -> Column:
    """First and last three lines of a text of more than six."""
    lines = F.split(text_or_empty(c), "\n")
    return F.when(F.size(lines) <= 6, c).otherwise(F.concat_ws("\n", F.slice(lines, 1, 3), F.lit("..."), F.slice(lines, -3, 3)))


# the same in DuckDB's SQL


def sql_normalize(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def sql_words(c: str, stop: tuple[str, ...] = STOP_WORDS) -> str:
    held = f"lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in stop)})" if stop else "lambda w: w <> ''"
    return f"list_distinct(list_filter(string_split({sql_normalize(c)}, ' '), {held}))"


def sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def sql_dedup_key(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[ \\t\\r\\n]+', ' ', 'g'))"
