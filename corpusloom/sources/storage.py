"""Tables that are replaced as a whole while they are read, and scratch space that driver and executors share.

A table is a folder of numbered versions; a reader takes the newest whole one, a writer adds the next and then lets the
older ones go, so a plan may read the table that it replaces and a run that dies leaves the last whole version.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder's path below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return f"{named.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table, oldest first."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)) and exists(spark, f"{path}/{n}/_SUCCESS"))


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version; an empty table of the schema where there is none."""
    found = versions(spark, path)
    if not found:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(f"{path}/v{found[-1]}")


def replace(df: DataFrame, path: str, keep: int = 1) -> DataFrame:
    """Write the next version, let all but the last keep ones before it go, and read the new one."""
    spark = df.sparkSession
    before = versions(spark, path)
    n = before[-1] + 1 if before else 0
    df.write.mode("overwrite").parquet(f"{path}/v{n}")
    for old in before[: max(0, len(before) + 1 - keep)]:
        delete(spark, f"{path}/v{old}")
    return spark.read.schema(df.schema).parquet(f"{path}/v{n}")
