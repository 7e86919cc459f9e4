"""Coverage reports: what was classified, scoped, judged and left open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unclassified(observations: DataFrame, examples: int = 5) -> DataFrame:
    """By document, the number of observations without a taxonomy; the first few of all are marked as examples."""
    bare = observations.where(F.col("taxonomy_id").isNull())
    first = bare.orderBy("ord").limit(examples).groupBy("document_id").agg(F.array_sort(F.collect_list("ord")).alias("examples"))
    return bare.groupBy("document_id").agg(F.count("*").alias("n")).join(first, "document_id", "left").select("document_id", "n", F.coalesce("examples", F.array().cast("array<bigint>")).alias("examples"))


def histograms(observations: DataFrame, *columns: str) -> DataFrame:
    """(histogram, value, n) of several columns in one pass, by grouping sets."""
    sets = observations.select(*columns).groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    which = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for c in columns])
    return sets.select(which.alias("histogram"), value.alias("value"), "n")


def degenerate_shares(rows: DataFrame, group: str, value: str, share: float = 0.9, least: int = 20) -> DataFrame:
    """Groups of at least ``least`` rows and whether one value has more than ``share`` of them."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    g = counts.groupBy(group).agg(F.sum("n").cast("bigint").alias("n"), F.max("n").alias("top_n"), F.max_by(value, F.struct("n", value)).alias("top_value"))
    return g.where(F.col("n") >= least).withColumn("degenerate", F.col("top_n") / F.col("n") > share)


def corpus(scope: DataFrame, trails: DataFrame, key: str) -> DataFrame:
    """Documents in scope, out of scope, undecided, and with a trail, over both tables; scope has ``in_scope``."""
    both = scope.select(key, "in_scope", F.lit(True).alias("scoped")).join(trails.select(key, F.lit(True).alias("trailed")).distinct(), key, "full_outer")
    n = lambda c: F.count_if(c).cast("bigint")
    return both.agg(F.count("*").cast("bigint").alias("total"), n(F.col("in_scope")).alias("in_scope"), n(~F.col("in_scope")).alias("out_of_scope"), n(F.col("scoped").isNull()).alias("undecided"), n(F.col("trailed").isNull()).alias("without_trail"))


def scope_ladder(documents: DataFrame, clauses: str = "n_clauses", verdict: str = "verdict") -> DataFrame:
    """in_scope, basis and confidence: no clause and one clause are out of scope, then the verdict, in scope without one."""
    n, v = F.col(clauses), F.col(verdict)
    return documents.withColumns({
        "in_scope": F.when(n < 2, False).otherwise(F.coalesce(v, F.lit(True))),
        "basis": F.when(n == 0, "empty").when(n < 2, "too_short").when(v.isNull(), "judge_failed").otherwise("judge"),
        "confidence": F.when(n == 0, 0.95).when(n < 2, 0.80).when(v.isNull(), 0.0).otherwise(0.9),
    })


def backbone(trails: DataFrame) -> DataFrame:
    """How many trails are ordered, signed, and have a reversal; trails has ordered, signed and reversals."""
    return trails.agg(F.count("*").alias("trails"), F.count_if("ordered").alias("ordered"), F.count_if("signed").alias("signed"), F.count_if(F.col("reversals") > 0).alias("with_reversals"))


def judgment_economics(pending: DataFrame, verdicts: DataFrame, tokens: int = 200) -> DataFrame:
    """By kind: verdicts held, items pending, and an estimate of the tokens those take."""
    p = pending.groupBy("kind").agg(F.count("*").alias("pending"))
    v = verdicts.groupBy("kind").agg(F.count("*").alias("verdicts"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return p.join(v, "kind", "full_outer").select("kind", n("verdicts"), n("pending"), (F.coalesce("pending", F.lit(0)) * tokens).cast("bigint").alias("estimated_tokens"))


def honesty(rows: DataFrame, *columns: str) -> DataFrame:
    """For each column, how many values are blank, defaulted to needs_review, or filled."""
    picks = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    long = rows.select(F.explode(F.array(*picks)).alias("x")).select("x.field", F.coalesce("x.value", F.lit("")).alias("value"))
    return long.groupBy("field").agg(F.count_if(F.col("value") == "").alias("blank"), F.count_if(F.col("value") == "needs_review").alias("needs_review"), F.count_if(~F.col("value").isin("", "needs_review")).alias("filled"))


def attention(items: DataFrame, checkpoint: Callable, order: str = "ord") -> DataFrame:
    """Items numbered, those with a reason first, each group in order.

    Items are sorted by ranges and numbered within their partition, after those of the partitions before, of which there is a row each.
    """
    need = F.when(F.size("reasons") > 0, 0).otherwise(1)
    sorted_ = checkpoint(items.withColumn("__need", need).repartitionByRange("__need", order).sortWithinPartitions("__need", order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in sorted_.groupBy("__part").count().collect())
    before = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    offsets = items.sparkSession.createDataFrame(before, "__part int, __before bigint")
    turn = F.row_number().over(Window.partitionBy("__part").orderBy("__need", order))
    return sorted_.withColumn("__turn", turn).join(offsets, "__part").withColumn("item", F.col("__before") + F.col("__turn")).drop("__need", "__part", "__turn", "__before")


def zero_clauses(documents: DataFrame) -> DataFrame:
    """(document_id, reason) of documents without a clause: every file failed, no file was found, or the files hold no text.

    ``documents`` has document_id, files, failed and clauses, each a number.
    """
    reason = F.when(F.col("files") == 0, "no_files").when(F.col("failed") >= F.col("files"), "all_failed").otherwise("no_text")
    return documents.where("clauses = 0").select("document_id", reason.alias("reason"))


def distinct_flags(flags: DataFrame, order: str = "ord") -> DataFrame:
    """Flags (document_id, kind, suggested_action, ord, ...), the first of those equal in the first three."""
    w = Window.partitionBy("document_id", "kind", "suggested_action").orderBy(order)
    return flags.withColumn("__turn", F.row_number().over(w)).where("__turn = 1").drop("__turn")
