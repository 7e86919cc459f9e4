"""What the operators of this subpackage share: where cut lineage is written, and guards on columns.

Every operator takes and returns DataFrames. Intermediate tables that are read more than once are written with
``checkpoint()`` or as Parquet in the folder that ``spark.checkpoint.dir`` names, which all executors can reach, so that
a lost executor costs a reread and not the run.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests on one machine), a temporary one is set."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not there:
        held = jsc.getCheckpointDir()
        there = held.get() if held.isDefined() else None
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="dealgrain-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> str:
    """Where ``df`` was written as Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``saved`` that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: columnar, so later readers prune columns."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df, name))


def find_here(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it; clusters ship it as usual."""
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{held}".rstrip(":")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    find_here(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    held = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in held:
        name, k = f"__{stem}_{k}", k + 1
    return name


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c.lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}; there are {', '.join(df.columns)}")


def unit(column) -> F.Column:
    """A number in [0, 1) that depends on the BIGINT alone: 32 bits of a multiplicative hash. Null gives null."""
    low = F.pmod(column, F.lit(2147483647))
    return F.pmod(low * F.lit(2654435761) + F.shiftright(low, 7) * F.lit(40503), F.lit(4294967296)) / F.lit(4294967296.0)
