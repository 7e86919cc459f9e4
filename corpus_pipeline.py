"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, and SentencePiece pieces, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns their columns unchanged but for
texts that lose lines; the last returns ``doc_id``, ``pieces``, ``n_pieces`` and ``round_trip``. ``run`` writes each stage as Parquet in the
folder that ``spark.checkpoint.dir`` names and reads it again for the next, then
deletes what the stage before had written.

SQL can't express the classifier, so there is no ``ORACLE_SQL``; ``tests/llm/test_llm_pipeline.py`` holds each stage against plain loops.

Every stage but the last returns the columns of its input, whatever their names and number, in their order; the operators take names that are free.
An empty table gives an empty one. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrain.llm import line_dedup, quality_classifier, sentencepiece_codec, simhash_dedup, source_mixing
from dealgrain.llm.queries import SENTENCEPIECE_MODEL
from dealgrain.llm.shared import find_here, read_table, removed, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 4 doesn't reject; it is trained on the labels of these documents.

    Null and empty texts are judged by the bias alone, so they stay unless most labels are bad. Repeated rows and rows that share an id are judged one by one.
    """
    find_here(spark)
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line repeats (operator 6), with ``n_chars`` of what is left; texts of which nothing is left go.

    Null texts stay as they are. An empty text has one blank line, and blank lines always stay. Of equal lines that of the smallest (doc_id, position) stays, a null id
    first; rows equal in id and text count as one and stay or go together.
    """
    find_here(spark)
    left = line_dedup.without_dropped(docs)
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2): that of the smallest doc_id, a null one first.

    Null texts all stay. Empty texts are copies of one another. Of rows equal in id and text one stays.
    """
    find_here(spark)
    return simhash_dedup.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to the target weights of sources, languages and topics (operator 7).

    Null sources and languages are a value of their own. Null and empty texts have no tokens and are sampled at their cell's rate, or the budget's. A null doc_id is
    sampled as 0; rows that share an id fall together where they share the cell.
    """
    find_here(spark)
    return source_mixing.sampled(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece pieces of each document (operator 5), a row each; other columns end here.

    A null text has null pieces, -1 of them, and a null round trip; an empty text none. Repeated rows give repeated rows.
    """
    find_here(spark)
    return sentencepiece_codec.sentencepiece_encode(docs, SENTENCEPIECE_MODEL)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixing", mixing), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = saved(out, f"pipeline-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
