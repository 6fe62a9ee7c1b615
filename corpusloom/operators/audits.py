"""Audits against the manifest, which is authoritative, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_noise_title
from .records import missing_values

MIN_TRIPLES = 50
#: Decisions on a title, and what stands for a missing one.
FINE, NOTHING_BETTER, CORRECTED, EMPTY_TITLE = "ja_ok", "ruins_sem_manifest", "corrigido", "(vazio)"


def codes(**tests: Column) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())


def sanity(graph: DataFrame) -> DataFrame:
    """Before a graph is saved: type as expected, and what the manifest has is there."""
    has = lambda x: F.size(x) > 0
    return graph.withColumn("problems", codes(missing_type=F.col("type").isNull() | (F.col("type") != F.col("m_type")), missing_subjects=has(F.col("m_subjects")) & ~has(F.col("subjects")), missing_date=(F.col("m_date") != "") & (F.coalesce("date", F.lit("")) == ""), missing_creators=has(F.col("m_creators")) & ~has(F.col("creators"))))


def conversion_status(has_meta: Column, parsed: Column, n_triples: Column, problems: Column, least: int = MIN_TRIPLES) -> Column:
    return F.when(~has_meta, "no_manifest_meta").when(~parsed, "parse_error").when(n_triples < least, "too_few_triples").when(F.size(problems) > 0, "ok_with_warnings").otherwise("ok")


def audit(graph: DataFrame, least: int = MIN_TRIPLES) -> DataFrame:
    """Problems of each work: type, mandatory fields, size, structure; missing values per field."""
    gone = {k: missing_values(F.col(f"m_{k}"), F.col(k)) for k in ("creators", "subjects")}
    out = graph.withColumns({f"missing_{k}": v for k, v in gone.items()})
    return out.withColumn("problems", codes(wrong_type=F.col("type") != F.col("m_type"), missing_title=F.coalesce("title", F.lit("")) == "", missing_creators=F.size("missing_creators") > 0, missing_date=(F.col("m_date") != "") & ~F.coalesce(F.col("date") == F.col("m_date"), F.lit(False)), missing_subjects=F.size("missing_subjects") > 0, few_triples=F.col("n_triples") < least, no_rhetorical=F.col("n_rhetorical") == 0))


def patch(audited: DataFrame) -> DataFrame:
    """Creators and date are replaced where found missing, title and subjects added, a wrong type replaced."""
    hit = lambda k: F.array_contains("problems", k)
    values = {"creators": F.when(hit("missing_creators"), F.col("m_creators")).otherwise(F.col("creators")), "date": F.when(hit("missing_date"), F.col("m_date")).otherwise(F.col("date")), "subjects": F.when(hit("missing_subjects"), F.array_distinct(F.concat("subjects", "missing_subjects"))).otherwise(F.col("subjects")), "title": F.when(hit("missing_title"), F.col("m_title")).otherwise(F.col("title")), "type": F.when(hit("wrong_type"), F.col("m_type")).otherwise(F.col("type"))}
    fields = ("missing_creators", "missing_date", "missing_subjects", "missing_title", "wrong_type")
    return audited.withColumn("added", sum((hit(k).cast("int") for k in fields), F.lit(0))).withColumns(values)


def validate(graph: DataFrame, optional: tuple[str, ...] = ("language",)) -> DataFrame:
    """The variant in which a wrong type and optional fields are recorded but are no problems."""
    out = audit(graph)
    loose = F.filter("problems", lambda p: ~p.isin("wrong_type", "few_triples", "no_rhetorical"))
    noted = codes(**{f"missing_{k}": (F.coalesce(f"m_{k}", F.lit("")) != "") & (F.coalesce(k, F.lit("")) == "") for k in optional})
    empty = (F.size("m_creators") == 0) & (F.size("m_subjects") == 0) & (F.col("m_date") == "")
    return out.withColumns({"noted": F.concat(F.filter("problems", lambda p: p == "wrong_type"), noted), "problems": loose, "manifest_empty": empty})


def repair_decision(current: Column, manifest: Column) -> Column:
    return F.when(~is_noise_title(current), FINE).when(is_noise_title(manifest), NOTHING_BETTER).otherwise(CORRECTED)


def download_status(held: Column, url: Column, head_bytes: Column, most: int, answered: Column, content_type: Column, size: Column, magic: Column) -> Column:
    """The state of a download, the first that applies; the states are those of sources.sinks."""
    pdf = F.contains(F.lower(content_type), F.lit("pdf")) | F.endswith(F.lower(url), F.lit(".pdf"))
    return F.when(held > 1024, "already_exists").when(url.isNull(), "no_pdf_url").when(head_bytes > most, "skipped_too_large").when(~answered, "download_failed").when(~pdf, "not_pdf").when(size > most, "skipped_too_large").when(magic != "%PDF-", "invalid_pdf").otherwise("ok")


def first_tier(*candidates: Column) -> Column:
    return F.coalesce(*candidates)
