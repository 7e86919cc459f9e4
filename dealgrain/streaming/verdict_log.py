"""The verdict log as a stream: verdicts arrive as files, and a table holds the last of each key.

The table is dealt into ``PARTS`` by a hash of the key. A micro-batch is validated, reduced to its last verdict a key and merged into the
parts that its keys are in; only those are written anew, and a manifest names the version of each part. Versions that neither this manifest nor the one before
names are deleted. A batch that is repeated after a failure starts from the manifest before it and gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import invalid_verdicts, latest_verdicts

SCHEMA = "key string, kind string, value string, seq bigint"
PARTS = 64


def read_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def merge(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The last verdict of each key over both, by seq."""
    return latest_verdicts(held.unionByName(batch)).select("key", "kind", "value", "seq")


def _folder(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, there = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []


def _manifest(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    """{part: version} after batch ``number``; a row a part."""
    if f"v{number}" not in _names(spark, f"{table}/manifest"):
        return {}
    return {r.part: r.version for r in spark.read.schema("part int, version bigint").json(f"{table}/manifest/v{number}").collect()}


def _read(spark: SparkSession, table: str, parts: dict[int, int]) -> DataFrame:
    paths = [f"{table}/parts/v{v}/part={p}" for p, v in sorted(parts.items())]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table as of the last batch."""
    done = max((int(n[1:]) for n in _names(spark, f"{table}/manifest")), default=-1)
    return _read(spark, table, _manifest(spark, table, done))


def follow(spark: SparkSession, log: str, table: str, checkpoint: str, allowed: dict[str, tuple[str, ...]], once: bool = True):
    """Starts the query; ``current`` reads its table, and rejects are written as ``table/rejects/vN`` for batch N."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        bad = invalid_verdicts(batch, allowed)
        bad.write.mode("overwrite").parquet(f"{table}/rejects/v{number}")
        part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
        good = batch.join(bad.select("key", "seq"), ["key", "seq"], "left_anti").select("key", "kind", "value", "seq")
        touched = {r.part for r in good.select(part.alias("part")).distinct().collect()}
        before = _manifest(spark, table, number - 1)
        held = _read(spark, table, {p: v for p, v in before.items() if p in touched})
        merge(held, good).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/parts/v{number}")
        now = {**before, **dict.fromkeys(touched, number)}
        spark.createDataFrame(sorted(now.items()), "part int, version bigint").coalesce(1).write.mode("overwrite").json(f"{table}/manifest/v{number}")
        needed = {*now.values(), *before.values()}
        for name, most in (("parts", needed), ("manifest", {number, number - 1})):
            for v in _names(spark, f"{table}/{name}"):
                if int(v[1:]) not in most:
                    fs, there = _folder(spark, f"{table}/{name}/{v}")
                    fs.delete(there, True)
        batch.unpersist()

    writer = read_log(spark, log).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(log: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Verdicts by kind in windows of event time, late ones up to the watermark."""
    return log.withWatermark(time, late).groupBy(F.window(time, every), "kind").agg(F.count("*").alias("n"))
