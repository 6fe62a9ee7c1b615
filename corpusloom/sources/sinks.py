"""Sinks: logs and reports as JSON lines, entities, the triple store, rejects, catalogue results, downloads, run state."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem
from ..plans import graph
from . import storage

TRIPLES = "s string, p string, o string, o_kind string, o_dt string"


def append_lines(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def overwrite_lines(df: DataFrame, path: str) -> None:
    """Write a report of JSON lines in place of the one before."""
    df.write.mode("overwrite").json(path)


def write_entities(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Entities as one table of JSON lines in buckets by a hash of their key; a file for each entity doesn't scale."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").json(path)


def read_entity(spark: SparkSession, path: str, schema: str, key: str, value, buckets: int = 64) -> DataFrame:
    """One entity's rows; only its bucket is read."""
    kind = T.StructType.fromDDL(schema)[key].dataType
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.schema(f"{schema}, bucket int").json(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Turtle text for interchange: a folder of text files whose blocks follow the prefixes of each file's first lines."""
    head = "\n".join(f"@prefix {k}: <{v}> ." for k, v in prefixes.items())
    blocks = graph.turtle(triples).select("block")
    blocks.mapInPandas(lambda batches: _with_head(batches, head), "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def _with_head(batches: Iterable[pd.DataFrame], head: str):
    first = True
    for b in batches:
        if len(b):
            yield pd.DataFrame({"value": ([head] if first else []) + b["block"].tolist()})
            first = False


# the triple store


def create_dataset(spark: SparkSession, path: str) -> bool:
    """An empty store where there is none; whether it was made."""
    if storage.versions(spark, path):
        return False
    storage.replace(spark.createDataFrame([], TRIPLES), path)
    return True


def load_triples(new: DataFrame, path: str, reload: bool = False) -> bool:
    """Merge triples into the store as a set.  A store that has some is left as it is unless reload is set, which merges
    again and clears nothing.  Whether something was loaded."""
    spark = new.sparkSession
    create_dataset(spark, path)
    held = storage.read(spark, path)
    if not reload and held.head(1):
        return False
    storage.replace(graph.as_set(held, new.select(*graph.COLUMNS)), path)
    return True


def replace_values(path: str, predicate: str, new: DataFrame) -> DataFrame:
    """In the store, the predicate's values of the subjects named (s) give way to the new ones (s, o)."""
    return storage.replace(graph.replace_values(storage.read(new.sparkSession, path), predicate, new), path)


# gates and catalogue


def split_rejects(judged: DataFrame, accepted: str, rejected: str) -> None:
    """Judged rows to two tables; the inputs stay where they are."""
    judged.where(~F.col("reject")).write.mode("overwrite").parquet(accepted)
    judged.where("reject").write.mode("overwrite").parquet(rejected)


def export_results(results: dict[str, DataFrame], path: str) -> None:
    """Each query's rows as JSON lines in a folder of its id."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{path}/query={name}")


# downloads

#: The states of a download, the magic bytes, and the size above which a file counts as there.
DOWNLOAD = ["already_exists", "no_pdf_url", "skipped_too_large", "download_failed", "not_pdf", "write_error", "invalid_pdf", "ok"]
PDF_MAGIC, THERE_BYTES, MOST_BYTES = b"%PDF-", 1024, 80_000_000
DOWNLOADED = "handle string, title string, filename string, url string, status string, size_bytes long, error string, content binary"


class TooLarge(Exception):
    """A body grew beyond the bound while it was read."""


def download(records: DataFrame, make: Callable[[], object], most: int = MOST_BYTES, there: DataFrame | None = None) -> DataFrame:
    """Download rows (handle, title, url) per task with a client: head(url) gives a length or None, get(url, most) gives
    (content type, body) or None and raises TooLarge.

    there is a table of (handle, size_bytes) that earlier runs have written.  A failure is a status, not the job's end;
    the digest of a file is taken natively by with_digest."""
    rows = records.select("handle", F.coalesce("title", F.lit("")).alias("title"), F.concat(stem(F.col("handle")), F.lit(".pdf")).alias("filename"), "url")
    held = F.lit(None).cast("long")
    if there is not None:
        sizes = there.groupBy("handle").agg(F.max("size_bytes").alias("held"))
        rows, held = rows.join(sizes, "handle", "left"), F.col("held")
    rows = rows.select("handle", "title", "filename", "url", held.alias("held"))

    def one(client, url):
        if (size := client.head(url) or 0) > most:
            return "skipped_too_large", size, f"{size} bytes > {most}", None
        try:
            answer = client.get(url, most)
        except TooLarge as e:
            return "skipped_too_large", None, str(e), None
        if answer is None:
            return "download_failed", 0, "no answer", None
        kind, body = answer
        if "pdf" not in kind.lower() and not url.lower().endswith(".pdf"):
            return "not_pdf", 0, f"Content-Type: {kind}", None
        if body[:5] != PDF_MAGIC:
            return "invalid_pdf", 0, "no magic bytes", None
        return "ok", len(body), None, body

    def run(batches):
        client = make()
        for b in batches:
            out = []
            for handle, title, name, url, size in zip(b["handle"], b["title"], b["filename"], b["url"], b["held"]):
                if not pd.isna(size) and size > THERE_BYTES:
                    row = "already_exists", int(size), None, None
                elif not url:
                    row = "no_pdf_url", 0, None, None
                else:
                    try:
                        row = one(client, url)
                    except OSError as e:
                        row = "download_failed", 0, f"{type(e).__name__}: {e}", None
                out.append((handle, title, name, url, *row))
            yield pd.DataFrame(out, columns=["handle", "title", "filename", "url", "status", "size_bytes", "error", "content"]).astype({"size_bytes": "Int64"})

    return rows.mapInPandas(run, DOWNLOADED)


def with_digest(downloaded: DataFrame) -> DataFrame:
    return downloaded.withColumn("md5", F.when(F.col("content").isNotNull(), F.md5("content")))


def write_downloads(downloaded: DataFrame, files: str, report: str) -> None:
    """Bodies to a table of files, everything else to a report; the rows are made once."""
    spark, at = downloaded.sparkSession, storage.scratch(downloaded.sparkSession, "downloads")
    with_digest(downloaded).write.parquet(at)
    made = spark.read.parquet(at)
    made.where("status = 'ok'").select("handle", "filename", "size_bytes", "md5", "content").write.mode("append").parquet(files)
    made.drop("content").write.mode("append").json(report)
    storage.delete(spark, at)


# runs


def write_run_log(spark: SparkSession, steps: list[dict], path: str, arguments: dict | None = None) -> None:
    """The log of a run, one row: when, with what, how long, and its steps."""
    row = (datetime.datetime.now(datetime.timezone.utc).isoformat(), json.dumps(arguments or {}, sort_keys=True), float(sum(s["seconds"] for s in steps)), [(s["step"], s["status"], float(s["seconds"]), s["error"]) for s in steps])
    kind = "timestamp string, args string, total_duration double, steps array<struct<step: string, status: string, seconds: double, error: string>>"
    append_lines(spark.createDataFrame([row], kind), path)


STATE = "resumption_token string, total_seen long, total_saved long, updated_at string"


def write_state(spark: SparkSession, path: str, token: str | None, seen: int, saved: int) -> None:
    """Where a harvest stands; the state before it goes once this one is whole."""
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    storage.replace(spark.createDataFrame([(token, seen, saved, now)], STATE), path)


def read_state(spark: SparkSession, path: str) -> tuple[str | None, int, int]:
    """(token, seen, saved); the start where nothing was written."""
    row = storage.read(spark, path, spark.createDataFrame([], STATE).schema).first()
    return (None, 0, 0) if row is None else (row["resumption_token"], row["total_seen"], row["total_saved"])
