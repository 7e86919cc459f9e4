"""Reading the driver's tables, and the views of them that stand in for a contract corpus.

Observations: a line item is one, its part's type the taxonomy, its order the document, its status the paper, its return
flag the outcome, its discount the direction of risk, its quantity the magnitude.
Trails: documents of one group of near copies are the versions of one agreement, in order of doc_id, the last one signed,
and their non-blank lines the clauses.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder that spark.checkpoint.dir names; on one machine, where it is unset, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(there or "file://" + tempfile.mkdtemp(prefix="dealgrain-"))
    return df.checkpoint(eager=True)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return item.join(part, item.l_partkey == part.p_partkey).select(
        F.when(F.col("p_size") < 50, F.col("p_type")).alias("taxonomy_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version"), F.col("p_size").cast("string").alias("clause_path"), F.col("p_name").alias("full_text"),
        F.when(t == 0, "none").when(t <= 0.04, "reworded_equivalent").when(t < 0.08, "substantive").otherwise("needs_review").alias("deviation"),
        F.when(d < 0.03, "better").when(d < 0.07, "neutral").otherwise("worse").alias("direction"), F.when(q < 10, "none").when(q < 35, "minor").otherwise("material").alias("magnitude"),
        F.when(F.col("l_linestatus") == "F", "our_paper").otherwise("counterparty_paper").alias("provenance"),
        F.when(F.col("l_returnflag") == "A", "signed").when(F.col("l_returnflag") == "R", "proposed_then_reversed").otherwise("unsigned").alias("outcome"),
        F.when((F.col("p_type") == "PROMO") & (q == 49), "stub").when(q == 50, "needs_review").otherwise("judge").alias("basis"),
        (F.col("l_orderkey") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


SQL_OBSERVATIONS = """observations AS (
  SELECT CASE WHEN p_size < 50 THEN p_type END AS taxonomy_id, l_orderkey AS document_id, l_linenumber AS version, CAST(p_size AS VARCHAR) AS clause_path, p_name AS full_text,
    CASE WHEN l_tax = 0 THEN 'none' WHEN l_tax <= 0.04 THEN 'reworded_equivalent' WHEN l_tax < 0.08 THEN 'substantive' ELSE 'needs_review' END AS deviation,
    CASE WHEN l_discount < 0.03 THEN 'better' WHEN l_discount < 0.07 THEN 'neutral' ELSE 'worse' END AS direction,
    CASE WHEN l_quantity < 10 THEN 'none' WHEN l_quantity < 35 THEN 'minor' ELSE 'material' END AS magnitude,
    CASE WHEN l_linestatus = 'F' THEN 'our_paper' ELSE 'counterparty_paper' END AS provenance,
    CASE WHEN l_returnflag = 'A' THEN 'signed' WHEN l_returnflag = 'R' THEN 'proposed_then_reversed' ELSE 'unsigned' END AS outcome,
    CASE WHEN p_type = 'PROMO' AND l_quantity = 49 THEN 'stub' WHEN l_quantity = 50 THEN 'needs_review' ELSE 'judge' END AS basis,
    l_orderkey * 1000000000000 + l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS ord
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

SQL_COUNTED = "counted AS (SELECT * FROM observations WHERE taxonomy_id IS NOT NULL AND outcome IN ('signed', 'proposed_then_reversed'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord from 1, line): trimmed lines that aren't blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return docs.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("ord"), F.trim("raw").alias("line")).where("line <> ''")


SQL_LINES = """lines AS (
  SELECT doc_id, ord, trim(raw) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS ord FROM documents)
  WHERE trim(raw) <> '')"""
