"""Mixing sources to target weights by iterative proportional fitting.

Token counts (four characters a token, at least one for a text) are summed in cells of source, language and topic. Fitting rakes the cells' weights in
turn to a target for each source, each language and each topic, ``ROUNDS`` times or until a round moves no weight by more
than ``TOLERANCE`` of the largest. A document's probability is its cell's
weight over its cell's tokens, scaled so that the expected tokens are ``BUDGET`` of all and capped at one, the excess
going to the other cells. A document is sampled when the hash of its doc_id is below that.

A target is its margin's share of the tokens to the power ``TEMPER``, over the sum of those powers: below 1 it lifts
small sources and languages and lowers a hot one. ``targets``, as {margin: {value: weight}}, overrides them at any number of
cells: named values get their weights, the others of that margin share what is left of 1 as before, and a margin's targets are scaled to a sum of 1. There is no topic
in the table, so ``topic_of`` names the form of the whole text: tables, lists, records with figures, or prose by length.

Cells are few however many documents there are, but their number can grow with the sources: up to ``SMALL`` cells,
counted first, are fitted on the driver, more by window sums over the table of cells, with the same result. Everything
else is one scan, one aggregation and a join with the cells.

Null sources and languages are a value of their own ("?"). Null and empty texts have no tokens; they are kept with their
cell's probability, and with the budget's where their cell has no token. A null doc_id hashes as 0. Rows that repeat get
the same result. Very long texts count whole. An empty table gives no row. With no token at all every document has the budget's probability. Other columns are ignored, or kept by ``sampled``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh, need, unit

ROUNDS = 20
TOLERANCE = 1e-13
BUDGET = 0.7
TEMPER = 0.7
SMALL = 200_000
BROADCAST = 20_000
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """The form of a text: records (digits), tables (bars), lists (many lines), or prose by length."""
    n = F.length(text)
    share = lambda mark: F.regexp_count(text, F.lit(mark)) / n
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(text.isNull() | (n == 0), "empty").when(share("[0-9]") > 0.05, "records").when(share("[|]") > 0.02, "tables")
        .when((lines > 3) & (n / lines < 80), "lists").when(n < 1000, "short").when(n < 10000, "article").otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("bigint")


def _fit(cells: pd.DataFrame, temper: float, rounds: int, targets: dict[str, dict[str, float]]) -> np.ndarray:
    """The raked weights; they sum to 1."""
    t = cells["tokens"].to_numpy(dtype=np.float64)
    w = t / t.sum()
    aims = []
    for m in MARGINS:
        code, names = pd.factorize(cells[m])
        aim = np.bincount(code, weights=t) ** temper
        if m in targets:
            named = np.array([targets[m].get(name, np.nan) for name in names], dtype=np.float64)
            free = np.isnan(named)
            rest = max(0.0, 1 - named[~free].sum())
            aim = np.where(free, aim * (rest / aim[free].sum() if aim[free].sum() else 0), named)
        aims.append((code, aim / aim.sum()))
    for _ in range(rounds):
        before = w
        for code, aim in aims:
            held = np.bincount(code, weights=w, minlength=len(aim))
            w = w * np.where(held > 0, aim / np.where(held > 0, held, 1), 0)[code]
        if np.abs(w - before).max() <= TOLERANCE * w.max():
            break
    return w / w.sum()


def _calibrate(t: np.ndarray, w: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * w / t) with the c at which the expected tokens are the budget's share."""
    factor = w / t
    order = np.lexsort((np.arange(len(t)), -factor))
    f, s = factor[order], t[order]
    want = budget * s.sum()
    before = np.cumsum(s) - s  # tokens of the cells that are taken whole
    after = (f * s)[::-1].cumsum()[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(after > 0, (want - before) / after, np.inf)
        first = np.flatnonzero(c * f <= 1)
        scale = c[first[0]] if len(first) else np.inf
        out = np.empty(len(t))
        out[order] = np.minimum(1, np.nan_to_num(scale * f, nan=1.0, posinf=1.0))
    if len(first):
        out[order[: first[0]]] = 1.0
    out[order[f <= 0]] = 0.0  # a target of 0, even where the others can't fill the budget
    return out


def _aims(cells: DataFrame, margin: str, temper: float, targets: dict[str, float] | None) -> DataFrame:
    """(margin, aim): the target of each value of a margin; they sum to 1."""
    aims = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("aim"))
    if targets is not None:
        spark = cells.sparkSession
        named = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], f"{margin} string, named double")
        aims = aims.join(named, margin, "left")
        given, free = aims.agg(F.sum("named"), F.sum(F.when(F.col("named").isNull(), F.col("aim")))).first()
        rest = max(0.0, 1 - (given or 0.0)) / free if free else 0.0
        aims = aims.select(margin, F.coalesce("named", F.col("aim") * F.lit(rest)).alias("aim"))
    whole = aims.agg(F.sum("aim")).first()[0]
    return aims.select(margin, (F.col("aim") / F.lit(whole)).alias(f"aim_{margin}"))


def _fit_wide(cells: DataFrame, temper: float, rounds: int, budget: float, targets: dict[str, dict[str, float]]) -> DataFrame:
    """The same over a DataFrame of cells: margins by window sums, the scale by bisection on aggregates."""
    total = cells.agg(F.sum("tokens")).first()[0]
    x = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for m in MARGINS:
        x = x.join(_aims(cells, m, temper, targets.get(m)), m)
    for turn in range(rounds):
        x = x.withColumn("before", F.col("w"))
        for m in MARGINS:
            held = F.sum("w").over(Window.partitionBy(m))
            x = x.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"aim_{m}") / held).otherwise(0.0))
        if turn % 5 == 4:
            x = cut(x)
            moved, most = x.agg(F.max(F.abs(F.col("w") - F.col("before"))), F.max("w")).first()
            if moved <= TOLERANCE * most:
                break
    x = cut(x)
    whole = x.agg(F.sum("w")).first()[0]
    x = x.withColumn("f", F.col("w") / F.lit(whole) / F.col("tokens"))
    low, high = 0.0, float(total) / max(x.agg(F.min(F.when(F.col("f") > 0, F.col("f") * F.lit(float(total))))).first()[0], 1e-300)
    for _ in range(100):
        mid = (low + high) / 2
        got = x.agg(F.sum(F.least(F.lit(1.0), F.col("f") * F.lit(mid)) * F.col("tokens"))).first()[0]
        low, high = (mid, high) if got < budget * total else (low, mid)
        if high - low <= 1e-13 * high:
            break
    return x.select(*MARGINS, F.least(F.lit(1.0), F.col("f") * F.lit(high)).alias("p"))


def _keyed(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> dict[str, Column]:
    return {"source": F.coalesce(docs[source_col].cast("string"), F.lit("?")), "lang": F.coalesce(docs[lang_col].cast("string"), F.lit("?")), "topic": topic_of(docs[text_col])}


def probabilities(light: DataFrame, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, small: int = SMALL) -> DataFrame:
    """(source, lang, topic, p) for the cells with tokens of (source, lang, topic, tokens)."""
    spark = light.sparkSession
    cells = cut(light.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    if cells.count() > small:
        return _fit_wide(cells, temper, rounds, budget, targets or {})
    table = cells.toPandas().sort_values(list(MARGINS)).reset_index(drop=True)
    if len(table):
        table["p"] = _calibrate(table["tokens"].to_numpy(dtype=np.float64), _fit(table, temper, rounds, targets or {}), budget)
    else:
        table["p"] = pd.Series(dtype="float64")
    return spark.createDataFrame([tuple(r) for r in table[[*MARGINS, "p"]].itertuples(index=False)], "source string, lang string, topic string, p double")


def source_mixing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", budget: float = BUDGET, **how) -> DataFrame:
    """``id_col``, the cell, ``n_tokens``, ``probability`` (6 places) and ``sampled``, for each document."""
    need(docs, id_col, text_col, source_col, lang_col)
    light = cut(docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in _keyed(docs, text_col, source_col, lang_col).items()], tokens_of(docs[text_col]).alias("tokens")))
    found = light.join(probabilities(light, budget, **how), list(MARGINS), "left")
    p = F.coalesce("p", F.lit(budget))
    return found.select(F.col("id").alias(id_col), *MARGINS, F.col("tokens").alias("n_tokens"), F.round(p, 6).alias("probability"), (unit(F.coalesce(F.col("id"), F.lit(0)).cast("bigint")) < p).alias("sampled"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", budget: float = BUDGET, **how) -> DataFrame:
    """The documents sampled, with all their columns.

    The cells' probabilities go to the scan of the documents: up to ``BROADCAST`` cells, counted first, are broadcast, so
    texts aren't shuffled; more are joined as Spark sees fit.
    """
    need(docs, id_col, text_col, source_col, lang_col)
    keys = _keyed(docs, text_col, source_col, lang_col)
    chance = probabilities(docs.select(*[c.alias(k) for k, c in keys.items()], tokens_of(docs[text_col]).alias("tokens")), budget, **how)
    names = {k: fresh(docs, k) for k in (*MARGINS, "p")}
    chance = cut(chance.select(*[F.col(k).alias(v) for k, v in names.items()]))
    if chance.count() <= BROADCAST:
        chance = F.broadcast(chance)  # counted: a few MB at most; beyond that the join shuffles
    both = docs.withColumns({names[k]: c for k, c in keys.items()}).join(chance, [names[m] for m in MARGINS], "left")
    return both.where(unit(F.coalesce(both[id_col], F.lit(0)).cast("bigint")) < F.coalesce(F.col(names["p"]), F.lit(budget))).select(*docs.columns)


def oracle(table: str = "documents", budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS) -> str:
    topic = """CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty'
      WHEN (length(text) - length(translate(text, '0123456789', ''))) / length(text) > 0.05 THEN 'records'
      WHEN (length(text) - length(translate(text, '|', ''))) / length(text) > 0.02 THEN 'tables'
      WHEN (length(text) - length(translate(text, chr(10), '')) + 1) > 3 AND length(text) / (length(text) - length(translate(text, chr(10), '')) + 1) < 80 THEN 'lists'
      WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 10000 THEN 'article' ELSE 'long' END"""
    raked = "w"
    for m in MARGINS:
        raked = f"(SELECT turn, source, lang, topic, tokens, aim_source, aim_lang, aim_topic, w * aim_{m} / sum(w) OVER (PARTITION BY {m}) AS w FROM {'fit WHERE turn < ' + str(rounds) if m == 'source' else raked})"
    return f"""
WITH RECURSIVE light AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, {topic} AS topic,
    CAST(coalesce(ceil(length(text) / 4), 0) AS BIGINT) AS n_tokens FROM {table}),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM light GROUP BY ALL HAVING sum(n_tokens) > 0),
aims AS (SELECT *, {", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}), {temper}) AS raw_{m}" for m in MARGINS)} FROM cells),
start AS (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS w,
  {", ".join(f"raw_{m} / (SELECT sum(x) FROM (SELECT DISTINCT {m}, raw_{m} AS x FROM aims)) AS aim_{m}" for m in MARGINS)} FROM aims),
fit AS (
  SELECT 0 AS turn, source, lang, topic, tokens, aim_source, aim_lang, aim_topic, w FROM start
  UNION ALL
  SELECT turn + 1, source, lang, topic, tokens, aim_source, aim_lang, aim_topic, w FROM {raked}),
done AS (SELECT source, lang, topic, tokens, w / sum(w) OVER () / tokens AS f FROM fit WHERE turn = {rounds}),
filled AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(f * tokens) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM done),
scale AS (SELECT max_by(({budget} * (SELECT sum(tokens) FROM done) - before) / after, f) AS c FROM filled
  WHERE ({budget} * (SELECT sum(tokens) FROM done) - before) / after * f <= 1),
chance AS (SELECT source, lang, topic, least(1.0, c * f) AS p FROM done, scale)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(p, {budget}), 6) AS probability,
  (((d.doc_id % 2147483647) * 2654435761 + ((d.doc_id % 2147483647) >> 7) * 40503) % 4294967296) / 4294967296.0 < coalesce(p, {budget}) AS sampled
FROM light d LEFT JOIN chance c ON c.source = d.source AND c.lang = d.lang AND c.topic = d.topic"""
