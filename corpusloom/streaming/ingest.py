"""Incremental ingest of manifest records with Structured Streaming.

New files are read once (the checkpoint keeps the place), records pass the harvest's predicates, and the first record
of a handle wins across runs: each micro-batch meets what the table has in the buckets of its handles by an anti-join, so
the state is the table itself and grows with the data on disk, not in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import accepted, year_passes
from ..sources.readers import MANIFEST, exists, first_wins

#: Words of accepted types and the first year.
ACCEPTED, FIRST_YEAR, LAST_YEAR = ["tese", "dissert", "thesis", "doctoral", "master"], 2000, 2100


def harvest_filter(types: Column, date: Column, words: list[str] | None = None, low: int = FIRST_YEAR, high: int = LAST_YEAR) -> Column:
    return accepted(types, ACCEPTED if words is None else words) & year_passes(date, low, high)


#: Folders that the table is dealt into by a hash of the handle; a batch reads those that it touches.
BUCKETS = 64


def bucket_of(handle: str = "handle") -> Column:
    return F.pmod(F.xxhash64(handle), F.lit(BUCKETS)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):  # the table comes with the first batch
        return spark.createDataFrame([], MANIFEST).withColumn("bucket", F.lit(0))
    return spark.read.schema(T.StructType([*MANIFEST.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def append_new(batch: DataFrame, path: str) -> None:
    """Add the records of handles that the table doesn't have; of repeated ones in the batch the earliest."""
    spark = batch.sparkSession
    new = first_wins(batch.where("handle is not null and handle <> ''"), "handle", "collected_at").withColumn("bucket", bucket_of())
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    held = stored(spark, path).where(F.col("bucket").isin(*touched)).select("handle")
    new.join(held, "handle", "left_anti").select(*MANIFEST.fieldNames(), "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, keep: Column | None = None):
    """Read what is new under source, append it to table and stop; returns the finished query."""
    rows = spark.readStream.schema(MANIFEST).json(source)
    rows = rows.where(harvest_filter(F.col("types"), F.col("date")) if keep is None else keep)
    query = rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pending(rows: DataFrame, log: DataFrame, statuses: list[str], limit: int | None = None) -> DataFrame:
    """What a re-run still has to do: rows whose handle the log doesn't name as finished."""
    left = rows.join(log.where(F.col("status").isin(*statuses)).select("handle"), "handle", "left_anti")
    return left if limit is None else left.orderBy("handle").limit(limit)
