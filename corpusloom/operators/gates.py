"""Quality gates: PDF files before they are structured, TEI documents after it.

Each gate adds reject and reasons; a reason is a code, with a detail after a colon where there is one.  A warning is a
reason that doesn't reject.  Inputs are never changed: rejected() and accepted() are two reads of the judged table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADING_AUTHOR, HEADING_TITLE, any_rule, floor_percent, garbage_ratio, handle_of

#: Bounds of the gates.
PDF_MAGIC, PDF_MIN_KB, PDF_MAX_MB, PDF_SAMPLE, PDF_DENSITY = "%PDF-", 10, 80, 51200, 0.05
TEI_BODY_CHARS, TEI_GARBAGE, TEI_SECTIONS, TEI_HEADING_AUTHORS, TEI_REF_GARBAGE, TEI_BAD_REFS, HEAD_CHARS = 800, 0.35, 2, 0.5, 0.3, 0.5, 2
#: The codes of reasons, those of files first, then those of documents; the last two only warn.
READ_ERROR, INVALID_MAGIC, TOO_SMALL, TOO_LARGE, LIKELY_SCAN = "read_error", "invalid_magic", "too_small", "too_large", "likely_scan"
PARSE_ERROR, TITLE_IS_TOC, NO_BODY, BODY_TOO_SHORT, HIGH_GARBAGE, FEW_SECTIONS = "parse_error", "title_is_toc", "no_body", "body_too_short", "high_garbage", "few_real_sections"
AUTHORS_UNRELIABLE, REFS_UNRELIABLE = "grobid_authors_unreliable", "grobid_refs_unreliable"


def _reasons(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves to even; format_string alone rounds them up."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def _bytes_text(x: Column) -> Column:
    """Bytes one to one as characters."""
    return F.decode(x, "ISO-8859-1")


def _shown(x: Column) -> Column:
    """Bytes as a literal: printable ones as they are, others as two hex digits."""
    one = lambda k: F.substring(x, k.cast("int"), F.lit(1))
    char = lambda k: F.when(_bytes_text(one(k)).rlike(r"^[ -~]$"), _bytes_text(one(k))).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(one(k)))))
    return F.concat(F.lit("b'"), F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: k <= F.length(x)), char), ""), F.lit("'"))


def density(content: Column) -> Column:
    """Share of printable ASCII among the first PDF_SAMPLE bytes; 0 for an empty file."""
    head = F.substring(content, 1, PDF_SAMPLE)
    return F.length(F.regexp_replace(_bytes_text(head), r"[^\x20-\x7e]", "")) / F.greatest(F.length(head), F.lit(1))


def gate_pdf(files: DataFrame, name: str = "name", length: str = "length", content: str = "content") -> DataFrame:
    """(handle, size_mb, text_density, reject, reasons) of files with a name, a length in bytes and their content.

    A file without the magic bytes has that one reason; a file that could not be read (null content) a read_error."""
    size, body = F.col(length), F.col(content)
    magic = F.coalesce(_bytes_text(F.substring(body, 1, 5)) == PDF_MAGIC, F.lit(False))
    share = density(body)
    kb, mb = size / 1024, size / 1e6
    found = _reasons(
        F.when(kb < PDF_MIN_KB, F.concat(F.lit(TOO_SMALL + ": "), _fixed(kb, 1), F.lit("KB"))),
        F.when(mb > PDF_MAX_MB, F.concat(F.lit(TOO_LARGE + ": "), _fixed(mb, 0), F.lit("MB"))),
        F.when(share < PDF_DENSITY, F.concat(F.lit(LIKELY_SCAN + ": density="), _fixed(100 * share, 1), F.lit("%"))),
    )
    unread = F.array(F.lit(READ_ERROR))
    reasons = F.when(body.isNull(), unread).when(~magic, F.array(F.concat(F.lit(INVALID_MAGIC + ": "), _shown(F.substring(body, 1, 5))))).otherwise(found)
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    out = files.select(F.col(name).alias("name"), handle_of(stem).alias("handle"), F.bround(mb, 2).alias("size_mb"), F.when(magic, F.bround(share, 3)).alias("text_density"), reasons.alias("reasons"))
    return out.withColumn("reject", F.size("reasons") > 0)


def gate_tei(parsed: DataFrame) -> DataFrame:
    """(handle, reject, reasons, metrics) of TEI documents as tei.outline() has them.

    Unreliable authors or references are warnings: the manifest replaces the first, nothing depends on the second."""
    heading = lambda x: any_rule(x, HEADING_TITLE, "(?iuU)")
    n_authors, toc = F.size("persons"), F.size(F.filter("persons", lambda p: any_rule(p, HEADING_AUTHOR, "(?iuU)")))
    body = F.coalesce("body", F.lit(""))
    garbage = garbage_ratio(body)
    good = F.size(F.filter("heads", lambda h: h.isNotNull() & (F.length(F.trim(h)) > HEAD_CHARS) & ~heading(h)))
    n_refs, bad_refs = F.size("ref_titles"), F.size(F.filter("ref_titles", lambda t: (t != "") & (garbage_ratio(t) > TEI_REF_GARBAGE)))
    title = F.when((F.col("title") != "") & heading(F.col("title")), TITLE_IS_TOC)
    authors = F.when((n_authors > 0) & (toc / n_authors > TEI_HEADING_AUTHORS), F.format_string(AUTHORS_UNRELIABLE + ": %d/%d", toc, n_authors))
    refs = F.when((n_refs > 0) & (bad_refs / n_refs > TEI_BAD_REFS), F.format_string(REFS_UNRELIABLE + ": %d/%d", bad_refs, n_refs))
    short = F.when(F.length(body) < TEI_BODY_CHARS, F.format_string(BODY_TOO_SHORT + ": %dch", F.length(body)))
    noisy = F.when(garbage > TEI_GARBAGE, F.concat(F.lit(HIGH_GARBAGE + ": "), _fixed(100 * garbage, 0), F.lit("%")))
    few = F.when(good < TEI_SECTIONS, F.format_string(FEW_SECTIONS + ": %d", good))
    broken, bare = F.col("status") == PARSE_ERROR, F.col("body").isNull()
    reasons = F.when(broken, F.array(F.lit(PARSE_ERROR))).when(bare, _reasons(title, authors, F.lit(NO_BODY))).otherwise(_reasons(title, authors, short, noisy, few, refs))
    rejects = F.when(broken | bare, F.lit(True)).otherwise(title.isNotNull() | short.isNotNull() | noisy.isNotNull() | few.isNotNull())
    metrics = F.struct(n_authors.alias("n_authors"), toc.alias("toc_authors"), F.length(body).alias("body_chars"), F.bround(garbage, 3).alias("garbage_ratio"), good.alias("good_sections"), F.size("heads").alias("total_sections"), n_refs.alias("n_refs"))
    stem = F.regexp_replace("name", r"(\.tei)?\.[^.]*$", "")
    return parsed.select("name", handle_of(stem).alias("handle"), rejects.alias("reject"), reasons.alias("reasons"), F.when(~broken, metrics).alias("metrics"))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("reject"))


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reject")


def reason_counts(judged: DataFrame) -> DataFrame:
    """How often each code rejects, the most frequent first."""
    code = F.substring_index(F.col("reason"), ":", 1)
    return rejected(judged).select(F.explode("reasons").alias("reason")).groupBy(code.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def gate_totals(judged: DataFrame) -> DataFrame:
    """One row: how many were judged, passed and rejected, and the floor percentages."""
    out = judged.agg(F.count("*").alias("total"), F.count_if(~F.col("reject")).alias("ok"), F.count_if("reject").alias("rejected"))
    return out.withColumns({"ok_percent": floor_percent(F.col("ok"), F.col("total")), "rejected_percent": floor_percent(F.col("rejected"), F.col("total"))})
