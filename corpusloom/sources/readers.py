"""Readers of manifests, logs and files as typed DataFrames, and their resolution rules."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text, _list = T.StringType(), T.ArrayType(T.StringType())

MANIFEST = T.StructType([T.StructField(k, _text) for k in ("oai_identifier", "handle", "handle_url", "title", "description", "publisher", "date", "language", "rights", "pdf_url_oai", "datestamp", "collected_at")] + [T.StructField(k, _list) for k in ("creators", "subjects", "types", "relations", "sets")])
DISCOURSE = T.StructType([T.StructField("handle", _text), T.StructField("status", _text), T.StructField("doc_title", _text), T.StructField("sections", T.ArrayType(T.StructType([T.StructField("section_index", T.IntegerType()), T.StructField("section_head", _text), T.StructField("text_length", T.IntegerType()), T.StructField("source", _text), *(T.StructField(k, _list) for k in ("claims", "contributions", "limitations", "future_work", "keywords_inferred")), T.StructField("rhetorical_type", _text)])))])


class ManifestNotFound(FileNotFoundError):
    """None of the candidate paths holds a manifest."""


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that with the greatest order; one aggregation, no sort of whole groups."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("_r")).select("_r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files whose line order matters; line grows along a file, and counts nothing else.

    Files are split as ever, so a large one is many tasks: a line's place is its split's start, then its place there."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"), "value")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records: blank and corrupt lines and rows without a handle go; the last line of a handle wins."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", MANIFEST))
    return last_wins(rows.where("r.handle is not null and r.handle <> ''").select("r.*", F.struct("file", "line").alias("_at")), "handle", "_at").drop("_at")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def find_manifest(spark: SparkSession, explicit: str | None, candidates: list[str]) -> str:
    """The first path that exists; a typed error else."""
    for path in ([explicit] if explicit else []) + candidates:
        if exists(spark, path):
            return path
    raise ManifestNotFound(", ".join(([explicit] if explicit else []) + candidates))


def load_manifest_index(spark: SparkSession, candidates: list[str]) -> tuple[DataFrame, str]:
    """The first candidate that gives a record; an empty table, and no path, if none does."""
    for path in candidates:
        if exists(spark, path) and (found := load_manifest(spark, path)).head(1):
            return found, path
    return spark.createDataFrame([], MANIFEST), ""


def titles(manifest: DataFrame) -> DataFrame:
    return manifest.select("handle", F.trim("title").alias("title")).where("handle <> '' and title <> ''")


def load_discourse(spark: SparkSession, path: str) -> DataFrame:
    """Discourse documents of a folder; files that can't be parsed are left out."""
    bad = T.StructType([*DISCOURSE.fields, T.StructField("_bad", _text)])
    rows = spark.read.schema(bad).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and handle is not null").drop("_bad")


def done(log: DataFrame, statuses: list[str]) -> DataFrame:
    """Handles that a log names as finished."""
    return log.where(F.col("status").isin(*statuses)).select("handle").distinct()


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, length, modificationTime, content) of the files that match; orderBy("name") of what is kept of them
    gives them in order, without a shuffle of their contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", "content")


def newest(rows: DataFrame, name: str, time: str) -> DataFrame:
    return rows.agg(F.max_by(name, time).alias(name))


def forward_fill(rows: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Each row's last value that is not null, in order within its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def turtle_blocks(lines: DataFrame) -> DataFrame:
    """Lines of Turtle files grouped under the subject that was named last: (file, subject, block)."""
    marked = lines.withColumn("named", F.when(F.col("value").rlike(r"^base:\S+\s+"), F.regexp_extract("value", r"^(base:\S+)\s+", 1)))
    filled = forward_fill(marked, "file", "line", "named", "subject").where("subject is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])
    return filled.groupBy("file", "subject").agg(F.array_join(texts, "\n").alias("block"))


def first_link(html, patterns: list[str]):
    """The first link by (pattern's rank, place) among a page's href values."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))

    def hit(pattern: str):
        return F.try_element_at(F.filter(links, lambda x: x.rlike(pattern)), F.lit(1))

    return F.coalesce(*map(hit, patterns))


def absolute(base: str, link):
    """A link made absolute against a site's root."""
    root = "{0.scheme}://{0.netloc}".format(urllib.parse.urlsplit(base))
    return F.when(link.rlike("^https?://"), link).when(F.startswith(link, F.lit("/")), F.concat(F.lit(root), link)).otherwise(F.concat(F.lit(root + "/"), link))
