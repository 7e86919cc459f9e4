"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

``RULES`` holds (rule, measure, least, most, from_words): a document of at least ``from_words`` words fails a rule when
its measure is below ``least`` or above ``most``. The measures are lengths, symbols, stop words and lines of the whole
text, computed by expressions that the JVM evaluates; no user function and no shuffle is involved, so the plan is a scan
and a projection at any size.

Words are what blanks, tabs and line ends separate. Null and empty texts have no word and fail ``words`` alone; every
ratio of theirs is 0. Very long texts take one pass like any other. Repeated rows give repeated results, an empty table
an empty result, and other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import need

STOP_WORDS = tuple(sorted(set("the of and to in is that for it as was with be by on are this or from at an not le la les de des et un une en du que qui dans pour est au sur par avec el los las y se del por con para es der die das und ist zu den von mit auf ein eine nicht für im sich dem".split())))
SYMBOLS = "#$%&*!|~^<>{}[]=+@_"

RULES: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("words", "n_words", 1, None, 0),
    ("word_length", "mean_word_chars", 2.0, 20.0, 5),
    ("symbols", "symbol_ratio", None, 0.4, 5),
    ("letters", "letter_word_ratio", 0.6, None, 5),
    ("stop_words", "stop_word_ratio", 0.02, None, 50),
    ("repeated_words", "repeat_ratio", None, 0.2, 5),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3, 5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9, 5),
    ("repeated_lines", "repeated_line_ratio", None, 0.8, 50),
)
MEASURES = ("n_chars_text", "n_words", "n_lines", "mean_word_chars", "symbol_ratio", "letter_word_ratio", "stop_word_ratio", "repeat_ratio", "ellipsis_line_ratio", "bullet_line_ratio", "repeated_line_ratio")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``id_col``, the measures, ``failed`` (names of the rules failed, joined by commas, in the table's order) and ``keep``.

    Ratios are rounded to 6 places after they were compared.
    """
    need(docs, id_col, text_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = docs.select(
        docs[id_col],
        text.alias("t"),
        F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("l"),
    )
    count = lambda f: F.size(F.filter("w", f)).cast("double")
    lines = lambda f: F.size(F.filter("l", f)).cast("double")
    n, m, t = F.size("w").cast("double"), F.size("l").cast("double"), F.col("t")
    measured = parts.select(
        F.col(id_col),
        F.length(t).cast("bigint").alias("n_chars_text"),
        n.cast("bigint").alias("n_words"),
        m.cast("bigint").alias("n_lines"),
        _ratio(F.length(F.translate(t, " \t\r\n", "")).cast("double"), n).alias("mean_word_chars"),
        _ratio((F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("double"), n).alias("symbol_ratio"),
        _ratio(count(lambda w: w.rlike(r"\p{L}")), n).alias("letter_word_ratio"),
        _ratio(count(lambda w: F.lower(w).isin(*STOP_WORDS)), n).alias("stop_word_ratio"),
        _ratio(F.size(F.filter("w", lambda w, i: (i > 0) & (F.get("w", i - 1) == w))).cast("double"), n).alias("repeat_ratio"),
        _ratio(lines(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")), m).alias("ellipsis_line_ratio"),
        _ratio(lines(lambda x: F.substring(F.ltrim(x), 1, 1).isin("•", "-", "*", "‣", "·")), m).alias("bullet_line_ratio"),
        _ratio(m - F.size(F.array_distinct("l")).cast("double"), m).alias("repeated_line_ratio"),
    )
    fails = []
    for rule, measure, least, most, start in rules:
        x = F.col(measure)
        bad = F.lit(False)
        if least is not None:
            bad = bad | (x < least)
        if most is not None:
            bad = bad | (x > most)
        fails.append(F.when(bad & (F.col("n_words") >= start), F.lit(rule)))
    failed = F.concat_ws(",", *fails)
    return measured.select(F.col(id_col), *[F.round(c, 6).alias(c) if c.endswith(("ratio", "mean_word_chars")) else F.col(c) for c in MEASURES], failed.alias("failed")).withColumn("keep", F.col("failed") == "")


def oracle(table: str = "documents", rules=RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    fails = ", ".join(
        f"CASE WHEN n_words >= {start} AND (" + " OR ".join(([f"{m} < {lo}"] if lo is not None else []) + ([f"{m} > {hi}"] if hi is not None else [])) + f") THEN '{r}' END"
        for r, m, lo, hi, start in rules
    )
    shown = ", ".join(f"round({c}, 6) AS {c}" if c.endswith(("ratio", "mean_word_chars")) else c for c in MEASURES)
    return f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l
  FROM {table}),
measured AS (
  SELECT doc_id, length(t) AS n_chars_text, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
    {ratio("length(translate(t, ' ' || chr(9) || chr(13) || chr(10), ''))", "len(w)")} AS mean_word_chars,
    {ratio(f"(length(t) - length(translate(t, '{SYMBOLS}', '')))", "len(w)")} AS symbol_ratio,
    {ratio("len(list_filter(w, lambda x: regexp_matches(x, '[[:alpha:]]|[^[:ascii:]]') AND regexp_matches(x, '\\p{L}')))", "len(w)")} AS letter_word_ratio,
    {ratio(f"len(list_filter(w, lambda x: lower(x) IN ({stop})))", "len(w)")} AS stop_word_ratio,
    {ratio("len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))", "len(w)")} AS repeat_ratio,
    {ratio("len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))", "len(l)")} AS ellipsis_line_ratio,
    {ratio("len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('•', '-', '*', '‣', '·')))", "len(l)")} AS bullet_line_ratio,
    {ratio("(len(l) - len(list_distinct(l)))", "len(l)")} AS repeated_line_ratio
  FROM parts),
judged AS (SELECT *, concat_ws(',', {fails}) AS failed FROM measured)
SELECT doc_id, {shown}, failed, failed = '' AS keep FROM judged"""
