"""Harvests over OAI-PMH into a manifest table: Dublin Core to records, filters, the first record of a handle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import all_values, first_value, handle_url, pdf_url
from ..sources.services import OaiSource
from .ingest import append_new, harvest_filter

#: The Dublin Core elements of a record's texts and lists.
TEXTS = {"title": "title", "description": "description", "publisher": "publisher", "date": "date", "language": "language", "rights": "rights"}
LISTS = {"creators": "creator", "subjects": "subject", "types": "type", "relations": "relation"}


def records(harvested: DataFrame, base_url: str = "", collected_at: Column | None = None) -> DataFrame:
    """Harvested rows (identifier, datestamp, sets, deleted, fields) as manifest records; deleted ones go.

    The handle is the identifier without its scheme and host; its link is built from base_url where the record names
    none."""
    handle = F.regexp_replace("identifier", "^oai:[^:]*:", "")
    got = lambda k: F.coalesce(F.col("fields")[k], F.array().cast("array<string>"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if collected_at is None else collected_at
    return harvested.where(~F.col("deleted")).select(
        F.col("identifier").alias("oai_identifier"), handle.alias("handle"), handle_url(got("identifier"), F.concat(F.lit(base_url + "/handle/"), handle)).alias("handle_url"),
        *(first_value(got(v)).alias(k) for k, v in TEXTS.items()), pdf_url(got("identifier")).alias("pdf_url_oai"), "datestamp", now.alias("collected_at"),
        *(all_values(got(v)).alias(k) for k, v in LISTS.items()), "sets",
    )


def harvest_all(spark: SparkSession, url: str, table: str, checkpoint: str, sets: list[str] | None = None, base_url: str = "", keep: Column | None = None, **options):
    """Harvest the sets page by page into a manifest table until the last page; returns the stopped query.

    The stream's checkpoint holds the resumption token, so a harvest that was stopped goes on where it stood, each set
    by itself; the table keeps the first record of a handle over sets and runs.  keep is the predicate on records; by
    default types and years as the collection wants them.  Options are those of the source: from, until, retries."""
    spark.dataSource.register(OaiSource)
    rows = spark.readStream.format("oai").options(url=url, sets=",".join(sets or [""]), **options).load()

    def store(batch: DataFrame, _) -> None:
        found = records(batch, base_url)
        append_new(found.where(harvest_filter(F.col("types"), F.col("date")) if keep is None else keep), table)

    query = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()
    try:
        while True:
            before = query.lastProgress and query.lastProgress["sources"][0]["endOffset"]
            query.processAllAvailable()
            if (now := query.lastProgress) and now["sources"][0]["endOffset"] == before:
                return query
    finally:
        query.stop()
