"""Agreement folders: their version files as rows, layouts, lint, and clauses parsed in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text_ops import looks_signed, natural_key
from .clauses import CLAUSES, build
from .text import ParseError, docx, pdf_pages, rtf_text

KINDS = ("docx", "pdf", "rtf")
CHANGES = "document_id string, version string, change_type string, author string, date string, text string, line int"


def scan(spark: SparkSession, root: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(path, content, document_id, file_name, kind, stem, version_ord): files below ``root``, a folder an agreement, in natural order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(root)
    parts = F.split("path", "/")
    named = files.select("path", "content", F.element_at(parts, -2).alias("document_id"), F.element_at(parts, -1).alias("file_name"))
    named = named.withColumn("kind", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))).withColumn("stem", F.regexp_replace("file_name", r"\.[^.]+$", ""))
    order = Window.partitionBy("document_id").orderBy(natural_key(F.col("stem")), "file_name")
    return named.withColumn("version_ord", F.row_number().over(order)).withColumn("looks_signed", looks_signed(F.col("stem")))


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """Files of the old binary format, which may hold earlier history."""
    return scan(spark, root, ("doc",)).select("document_id", "file_name", F.lit("warning").alias("level"), F.lit("legacy_doc").alias("code"))


def _lines(kind: str, content: bytes) -> list[tuple[str, int]]:
    if kind == "docx":
        return docx(content).lines
    text = rtf_text(content) if kind == "rtf" else "\n".join(pdf_pages(content))
    return [(x, 0) for x in map(str.strip, text.splitlines()) if x]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in CLAUSES.split(", ")]
    for batch in batches:
        rows = []
        for f in batch.itertuples():
            try:
                found = list(build(_lines(f.kind, f.content)))
            except ParseError as e:
                found = [{"ord": -1, "text": str(e)}]
            rows += [{**dict.fromkeys(columns), "document_id": f.document_id, "version": str(f.version_ord), "source_file": f.file_name, **r} for r in found]
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype({c: "Int64" for c in ("ord", "depth", "start", "end", "page")})


def parsed(files: DataFrame) -> DataFrame:
    """Clause rows of ``scan``'s files. A file that can't be parsed gives one row with ord -1 and the reason as text."""
    return files.select("document_id", "version_ord", "file_name", "kind", "content").mapInPandas(_parse, CLAUSES)


def cached(files: DataFrame, table: str, fingerprint: str) -> DataFrame:
    """``parsed`` of the files, each content parsed once: rows are kept in ``table`` by a key of the content and the parser's fingerprint, failures too.

    What is new is appended; equal files share their rows.
    """
    spark = files.sparkSession
    keyed = files.select("document_id", "version_ord", "file_name", "kind", "content", F.sha2(F.concat(F.sha2("content", 256), F.lower("kind"), F.lit(fingerprint)), 256).alias("content_key"))
    there = spark._jvm.org.apache.hadoop.fs.Path(table)
    held = spark.read.parquet(table) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else None
    new = keyed.dropDuplicates(["content_key"])
    if held is not None:
        new = new.join(held.select("content_key").distinct(), "content_key", "left_anti")
    asked = new.select(F.col("content_key").alias("document_id"), F.lit(0).alias("version_ord"), F.lit("").alias("file_name"), "kind", "content")
    rows = parsed(asked).withColumnRenamed("document_id", "content_key").drop("version", "source_file")
    rows.write.mode("append").parquet(table)
    every = spark.read.schema(rows.schema).parquet(table).dropDuplicates(["content_key", "ord"])
    found = keyed.select("document_id", F.col("version_ord").cast("string").alias("version"), F.col("file_name").alias("source_file"), "content_key").join(every, "content_key")
    return found.select(*[c.split(" ")[0] for c in CLAUSES.split(", ")])


def layout(listing: DataFrame) -> str:
    """flat, clm_nested or manifest: what a listing (path, of the folders and files below a root) looks like."""
    path = F.lower("path")
    r = listing.agg(F.coalesce(F.bool_or(path.endswith("manifest.jsonl")), F.lit(False)), F.coalesce(F.bool_or(path.contains("/versions/") | F.element_at(F.split("path", "/"), -1).startswith("EXECUTED_")), F.lit(False))).first()
    return "manifest" if r[0] else "clm_nested" if r[1] else "flat"


def quarantined(clauses: DataFrame) -> DataFrame:
    return clauses.where("ord = -1").select("document_id", "version", "source_file", F.col("text").alias("reason"))


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in CHANGES.split(", ")]
    for batch in batches:
        rows = []
        for f in batch.itertuples():
            try:
                rows += [{"document_id": f.document_id, "version": str(f.version_ord), **c} for c in docx(f.content).changes]
            except ParseError:
                continue  # parsed() reports the file
        yield pd.DataFrame(rows, columns=columns)


def tracked_changes(files: DataFrame) -> DataFrame:
    """Insertions and deletions with author and date, of the files that record them."""
    return files.where("kind = 'docx'").select("document_id", "version_ord", "content").mapInPandas(_changes, CHANGES)


def version_files(files: DataFrame) -> DataFrame:
    """Content addresses of versions, for citations and caches."""
    return files.select("document_id", F.col("version_ord").alias("version"), "path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), "kind")


def stale(files: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Documents whose key isn't in ``cache``: the key covers their files, their order and the configuration's fingerprint."""
    line = F.concat_ws("|", F.lpad(F.col("version").cast("string"), 6, "0"), "sha256")
    keyed = version_files(files).groupBy("document_id").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line)), F.lit(fingerprint)), 256).alias("doc_key"))
    return keyed.join(cache.select("doc_key"), "doc_key", "left_anti")


def staged(listing: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(folder, staged_name, signed) of a listing (folder, file_name): NN__name in natural order, the last signed-looking file signed.

    A manifest (folder, file_name, version_number, status) gives order and status instead where it names the file.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    rows = listing.withColumn("__key", natural_key(stem))
    if manifest is not None:
        rows = rows.join(manifest.select("folder", "file_name", "version_number", F.upper("status").contains("EXECUTED").alias("__executed")), ["folder", "file_name"], "left")
    else:
        rows = rows.withColumn("version_number", F.lit(None).cast("int")).withColumn("__executed", F.lit(None).cast("boolean"))
    order = Window.partitionBy("folder").orderBy(F.col("version_number").asc_nulls_last(), "__key", "file_name")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("__signed", F.coalesce("__executed", looks_signed(stem)))
    last = F.max(F.when(F.col("__signed"), F.col("n"))).over(Window.partitionBy("folder"))
    return rows.withColumn("signed", F.coalesce(F.col("n") == last, F.lit(False))).select("folder", F.format_string("%02d__%s", "n", "file_name").alias("staged_name"), "file_name", "signed")


def lint(listing: DataFrame) -> DataFrame:
    """(level, code, folder, detail): folders with a single version, stems that repeat but for case, unsupported files."""
    kind = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    rows = listing.withColumn("kind", kind).withColumn("stem", F.lower(F.regexp_replace("file_name", r"\.[^.]+$", "")))
    good = rows.where(F.col("kind").isin(*KINDS))
    item = lambda df, level, code, detail: df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), "folder", detail.alias("detail"))
    single = item(good.groupBy("folder").agg(F.count("*").alias("n"), F.min("file_name").alias("f")).where("n = 1"), "info", "single_version", F.col("f"))
    twice = item(good.groupBy("folder", "stem").agg(F.count("*").alias("n")).where("n > 1"), "warning", "duplicate_stem", F.col("stem"))
    other = item(rows.where(~F.col("kind").isin(*KINDS)), "warning", "unsupported", F.col("file_name"))
    return single.unionByName(twice).unionByName(other)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
