"""Parsed documents and their manifest to works, and repairs of titles in the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import WORK_TYPES, date_literal, handle_of, work_type
from . import audits, records

DEFAULT_TYPE = "MastersThesis"


def matched(parsed: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed documents with their manifest record (columns m_*), and those that have none.

    The handle is the file's stem with its first underscore as a slash."""
    stem = F.regexp_replace("name", r"(\.tei)?\.[^.]*$", "")
    named = parsed.withColumn("handle", handle_of(stem))
    known = manifest.select("handle", *(F.col(c).alias(f"m_{c}") for c in manifest.columns if c != "handle"))
    return named.join(known, "handle"), named.join(known.select("handle"), "handle", "left_anti")


def clean_refs(refs: Column) -> Column:
    """References with a title that is one: year as it is, authors who are some, REF_AUTHORS at most."""
    kept = F.filter(refs, lambda r: (F.coalesce(r["title"], F.lit("")) != "") & ~records.is_bad_reference(r["title"]))
    return F.transform(kept, lambda r: F.struct(r["title"].alias("title"), r["year"].alias("year"), records.reference_authors(r["authors"]).alias("authors")))


def structure(parsed: DataFrame, manifest: DataFrame) -> DataFrame:
    """A work per parsed document with a manifest record: the manifest is authoritative but for title and text.

    Columns: handle, title, authors, abstract, type, date (lex, kind), subjects, language, url, sections with a class,
    refs."""
    rows, _ = matched(parsed.where(F.col("status") == "ok"), manifest)
    classed = F.transform("sections", lambda s: F.struct(s["head"].alias("head"), s["n"].alias("n"), rules.section_class(s["head"]).alias("class"), s["paragraphs"].alias("paragraphs")))
    none = F.array().cast("array<string>")
    return rows.select(
        "handle",
        records.first_title(F.col("title"), F.col("m_title")).alias("title"),
        records.preferred_list(F.coalesce("m_creators", none), records.valid_authors(F.coalesce("authors", none))).alias("authors"),
        records.choose_abstract(rules.abstract_of(F.coalesce("abstract", none)), F.col("m_description")).alias("abstract"),
        work_type(F.coalesce("m_types", none), WORK_TYPES, DEFAULT_TYPE).alias("type"),
        date_literal(F.coalesce("m_date", F.lit(""))).alias("date"),
        F.coalesce("m_subjects", none).alias("subjects"),
        F.coalesce("m_language", F.lit("")).alias("language"),
        F.coalesce("m_handle_url", F.lit("")).alias("url"),
        classed.alias("sections"),
        clean_refs(F.col("refs")).alias("refs"),
    )


def repair_titles(manifest: DataFrame, current: DataFrame, key: str = "handle") -> DataFrame:
    """(key, old, new, decision) of every manifest record with a title: one join with the store's titles, whatever their
    number.  manifest: key, title; current: key, title, one row a key."""
    wanted = manifest.where((F.coalesce("title", F.lit("")) != "") & F.col(key).isNotNull()).select(key, F.trim("title").alias("new"))
    held = current.select(key, F.col("title").alias("old"))
    return wanted.join(held, key, "left").select(key, "old", "new", audits.repair_decision(F.col("old"), F.col("new")).alias("decision"))


def corrections(repairs: DataFrame, key: str = "handle") -> DataFrame:
    """What is to be written: (key, old, new) where the manifest's title replaces the store's."""
    return repairs.where(F.col("decision") == audits.CORRECTED).select(key, F.coalesce(F.nullif("old", F.lit("")), F.lit(audits.EMPTY_TITLE)).alias("old"), "new")


def repair_counts(repairs: DataFrame) -> DataFrame:
    return repairs.groupBy("decision").agg(F.count("*").alias("n"))
