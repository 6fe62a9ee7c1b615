"""Shaping of bibliographic records, sections and references, as column expressions and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alpha_ratio, any_rule, contains_any, digit_ratio, is_heading_author

#: Lengths that the choices depend on.
ABSTRACT_CHARS, SHORT_ABSTRACT, PARA_CHARS, ITEM_CHARS, REF_AUTHORS, REF_AUTHOR_WORDS, AUTHOR_WORDS = 100, 20, 30, 10, 3, 4, 5


def first_value(values: Column) -> Column:
    """First value trimmed, or the empty text."""
    return F.coalesce(F.trim(F.try_element_at(values, F.lit(1))), F.lit(""))


def all_values(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def last_matching(values: Column, test, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, test), F.lit(-1)), otherwise)


def handle_url(identifiers: Column, built: Column) -> Column:
    return last_matching(identifiers, lambda x: F.startswith(x, F.lit("http")) & F.contains(x, F.lit("handle")), built)


def pdf_url(identifiers: Column) -> Column:
    return last_matching(identifiers, lambda x: F.endswith(F.lower(x), F.lit(".pdf")), F.lit(None).cast("string"))


def first_title(*candidates: Column) -> Column:
    return F.coalesce(*(F.nullif(F.coalesce(x, F.lit("")), F.lit("")) for x in candidates))


def preferred_list(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(b)


def choose_abstract(parsed: Column, manifest: Column) -> Column:
    """The parsed one if long, else the manifest's if not tiny, else whatever there is."""
    p, m = F.coalesce(parsed, F.lit("")), F.coalesce(manifest, F.lit(""))
    return F.when(F.length(p) >= ABSTRACT_CHARS, p).when(F.length(m) >= SHORT_ABSTRACT, m).when(p != "", p).otherwise(m)


def abstract_paragraph(paragraphs: Column, skip: list[str], markers: list[str]) -> Column:
    """The first paragraph that opens with a marker, else the longest (the first of equal ones), thanks left out."""
    kept = F.filter(paragraphs, lambda x: ~contains_any(F.substring(x, 1, 120), skip))
    marked = F.try_element_at(F.filter(kept, lambda x: contains_any(F.substring(x, 1, 80), markers)), F.lit(1))
    ranked = F.transform(kept, lambda x, k: F.struct(F.length(x).alias("n"), (-k).alias("k"), x.alias("x")))
    return F.coalesce(marked, F.array_max(ranked)["x"])


def person(forenames: Column, surname: Column) -> Column:
    return F.trim(F.concat_ws(" ", forenames, surname))


def valid_authors(names: Column) -> Column:
    """Distinct names in order: at most five words, no digit, no heading."""
    return F.array_distinct(F.filter(names, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= AUTHOR_WORDS) & ~x.rlike(r"\d") & ~is_heading_author(x)))


#: Titles of references that are places, links or page numbers.
BAD_REFERENCE = [r"^disponível\s+em\b", r"^acesso\s+em\b", r"^rio\s+de\s+janeiro\b", r"^s[ãa]o\s+paulo\b", r"^referências\s+bibliogr", r"^\s*https?://", r"^\s*www\.", r"^\s*p\.\s*\d", r"^\d{1,4}\s*$", r"^in:\s"]


def is_bad_reference(title: Column) -> Column:
    t = F.trim(F.lower(title))
    words = F.size(F.filter(F.split(t, r"(?U)\W+"), lambda w: F.length(w) > 1))
    return (F.length(t) < 5) | (words < 2) | (digit_ratio(t) > 0.4) | any_rule(t, BAD_REFERENCE) | (alpha_ratio(t) * F.length(t) < 11)


def reference_authors(names: Column) -> Column:
    return F.slice(F.filter(names, lambda x: (F.size(F.split(x, r"\s+")) <= REF_AUTHOR_WORDS) & ~is_heading_author(x)), 1, REF_AUTHORS)


def first_section(sections: DataFrame, keywords: list[str], chars: int, limit: int) -> DataFrame:
    """Each document's first section whose head holds a keyword and which is long enough; the first documents."""
    hit = sections.where(contains_any(F.col("head"), keywords) & (F.col("n_chars") >= chars))
    first = hit.groupBy("doc_id").agg(F.min_by(F.struct("i", "head", "n_chars"), "i").alias("s"))
    return first.orderBy("doc_id").limit(limit).select("doc_id", "s.*")


def lowest_tier(rows: DataFrame, key: str, tier: str) -> DataFrame:
    """The rows of each key's lowest tier: fallbacks apply only where nothing better was found."""
    least = F.min(tier).over(Window.partitionBy(key))
    return rows.withColumn("_least", least).where(F.col(tier) == F.col("_least")).drop("_least")


def year_passes(date: Column, low: int, high: int) -> Column:
    """Within the years; unreadable, missing and zero years pass."""
    y = F.substring(F.coalesce(date, F.lit("")), 1, 4).try_cast("int")
    return y.isNull() | (y == 0) | y.between(low, high)


def accepted(types: Column, words: list[str], deleted: Column | None = None) -> Column:
    ok = F.coalesce(F.exists(types, lambda t: contains_any(t, words)), F.lit(False))
    return ok if deleted is None else ok & ~deleted


def missing_values(wanted: Column, have: Column) -> Column:
    """Wanted values that are not there; repeated ones stay repeated."""
    return F.filter(wanted, lambda v: (v != "") & ~F.coalesce(F.array_contains(have, v), F.lit(False)))


def shorten(x: Column, prefixes: list[str], chars: int = 120) -> Column:
    for p in prefixes:
        x = F.replace(x, F.lit(p), F.lit(""))
    return F.substring(x, 1, chars)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order that looks random and is the same for the same seed and keys, wherever they lie."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return rows.orderBy(F.md5(text), *keys)
