"""The graph as a de-duplicated table of triples, and set operations on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import Corpus

COLUMNS = ["s", "p", "o", "o_kind", "o_dt"]
KIND_EDGE = {"claim": "discourse:hasClaim", "contribution": "discourse:hasContribution", "limitation": "discourse:hasLimitation", "future": "discourse:hasFutureWork"}


def _rows(df: DataFrame, s: Column, p: str | Column, o: Column, kind: str = "lit", dt: str = "") -> DataFrame:
    return df.select(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"))


def node(*parts) -> Column:
    """base:<handle stem> with suffixes."""
    return F.concat(F.lit("base:11422_"), F.col("doc_id").cast("string"), *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def description_triples(c: Corpus) -> DataFrame:
    """What is said of the works themselves, before set semantics; titles and languages come without the joins of a work."""
    w, t = c.works, c.texts
    parts = [
        _rows(w, node(), "a", F.concat(F.lit("fabio:"), F.col("type")), "iri"),
        _rows(t, node(), "a", F.lit("fabio:Work"), "iri"),
        _rows(w, node(), "bibo:handle", F.col("handle")),
        _rows(t, node(), "dcterms:title", F.col("title")),
        _rows(w.where("date_lex is not null"), node(), "dcterms:date", F.col("date_lex"), "lit", "xsd:date"),
        _rows(t, node(), "dcterms:language", F.col("lang")),
        _rows(c.creators, node(), "dcterms:creator", F.col("creator")),
        _rows(c.subjects, node(), "dcterms:subject", F.col("subject")),
    ]
    return reduce(DataFrame.unionByName, parts)


def work_triples(c: Corpus) -> DataFrame:
    """Works, sections, paragraphs and references, before set semantics."""
    sec, par, ref = c.sections, c.paragraphs, c.refs
    sec_id, par_id, ref_id = node("_sec_", F.col("i")), node("_sec_", F.col("i"), "_para_", F.col("j")), node("_ref_", F.col("k"))
    both = F.explode(F.array_distinct(F.array(F.concat(F.lit("deo:"), F.col("class")), F.lit("doco:Section"))))
    parts = [
        description_triples(c),
        _rows(sec, node(), "po:contains", sec_id, "iri"),
        _rows(sec.select("doc_id", "i", both.alias("t")), sec_id, "a", F.col("t"), "iri"),
        _rows(sec, sec_id, "dcterms:title", F.col("head")),
        _rows(par, sec_id, "po:contains", par_id, "iri"),
        _rows(par, par_id, "a", F.lit("doco:Paragraph"), "iri"),
        _rows(par, par_id, "c4o:hasContent", F.col("content")),
        _rows(ref, node("_references"), "po:contains", ref_id, "iri"),
        _rows(ref, ref_id, "a", F.lit("bibo:Article"), "iri"),
        _rows(ref, ref_id, "dcterms:title", F.col("ref_title")),
    ]
    return reduce(DataFrame.unionByName, parts)


def discourse_triples(c: Corpus, least: int = 10) -> DataFrame:
    """Items of ten characters or more: from the work and, but for future work, from their section."""
    it = c.items.where(F.length("content") >= least)
    item = node("_", F.col("kind"), "_", F.col("j"))
    edge = F.create_map(*(F.lit(x) for kv in KIND_EDGE.items() for x in kv))[F.col("kind")]
    disc = node("_disc_sec_", F.col("sec"))
    parts = [
        _rows(c.disc_sections, disc, "a", F.concat(F.lit("deo:"), F.col("class")), "iri"),
        _rows(c.disc_sections, node(), "discourse:hasAnalyzedSection", disc, "iri"),
        _rows(it, node(), edge, item, "iri"),
        _rows(it.where("kind <> 'future'"), disc, edge, item, "iri"),
        _rows(it, item, "c4o:hasContent", F.col("content")),
        _rows(c.keywords.join(c.works.select("doc_id"), "doc_id", "left_semi"), node(), "discourse:inferredKeyword", F.col("keyword")),
    ]
    return reduce(DataFrame.unionByName, parts)


def as_set(*graphs: DataFrame) -> DataFrame:
    """Union without repeats: loading twice changes nothing."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates(COLUMNS)


def remove(graph: DataFrame, gone: DataFrame) -> DataFrame:
    cond = [graph[c].eqNullSafe(gone[c]) for c in COLUMNS]
    return graph.join(gone, cond, "left_anti")


def replace_values(graph: DataFrame, predicate: str, new: DataFrame) -> DataFrame:
    """Delete the predicate's values of the named subjects (s) and insert the new ones (s, o)."""
    old = graph.where(F.col("p") == predicate).join(new.select("s").distinct(), "s", "left_semi")
    kept = graph.where(F.col("p") != predicate).unionByName(graph.where(F.col("p") == predicate).join(new.select("s").distinct(), "s", "left_anti"))
    added = _rows(new, F.col("s"), predicate, F.col("o"))
    return as_set(kept.select(*COLUMNS), added) if old is not None else kept


def turtle(graph: DataFrame) -> DataFrame:
    """One text per subject: predicates and objects in order; literals are quoted and escaped."""
    text = F.concat(F.lit('"'), F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.when(F.col("o_dt") != "", F.concat(F.lit("^^"), F.col("o_dt"))).otherwise(""))
    line = F.concat(F.lit("    "), "p", F.lit(" "), F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(text))
    return graph.select("s", line.alias("line")).groupBy("s").agg(F.concat(F.first("s"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list("line")), " ;\n"), F.lit(" .")).alias("block"))
