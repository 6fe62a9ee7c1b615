"""TEI documents parsed per partition; a document that is not well formed gives a status, not a failed job."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workers import map_slices

NS = {"t": "http://www.tei-c.org/ns/1.0"}
PARA_CHARS, BODY_CHARS = 30, 500

#: Where authors are looked for, in this order.
AUTHOR_PATHS = (".//t:fileDesc//t:analytic//t:persName", ".//t:author//t:persName", ".//t:sourceDesc//t:persName")

PARSED = "name string, status string, title string, authors array<string>, abstract array<string>, sections array<struct<head: string, n: string, paragraphs: array<string>>>, refs array<struct<title: string, year: string, authors: array<string>>>, body_chars long"


def text_of(node) -> str:
    """All text below a node, joined by blanks, white space collapsed."""
    return "" if node is None else " ".join(" ".join(node.itertext()).split())


def _person(node) -> str:
    names = [text_of(x) for x in node.findall("t:forename", NS)] + [text_of(node.find("t:surname", NS))]
    return " ".join(x for x in names if x)


def parse(content: str | bytes) -> dict:
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return {"status": "parse_error"}
    body = root.find(".//t:text/t:body", NS)
    if body is None:
        return {"status": "no_body_element"}
    authors: list[str] = []
    for path in AUTHOR_PATHS:  # the first path that gives anyone
        authors = authors or [p for x in root.findall(path, NS) if (p := _person(x))]
    sections = []
    for div in body.iter(f"{{{NS['t']}}}div"):
        head = div.find("t:head", NS)
        paragraphs = [p for x in div.findall("t:p", NS) if len(p := text_of(x)) >= PARA_CHARS]
        if text_of(head) or paragraphs:
            sections.append({"head": text_of(head), "n": head.get("n", "") if head is not None else "", "paragraphs": paragraphs})
    refs = []
    for bib in root.findall(".//t:listBibl/t:biblStruct", NS):
        title = next((t for level in "am" if (t := text_of(bib.find(f".//t:title[@level='{level}']", NS)))), "")
        date = bib.find(".//t:date[@type='published']", NS)
        refs.append({"title": title, "year": (date.get("when", "") if date is not None else "")[:4], "authors": [p for x in bib.findall(".//t:persName", NS) if (p := _person(x))]})
    size = len(text_of(body))
    return {"status": "ok" if size >= BODY_CHARS else "short_body", "title": text_of(root.find(".//t:titleStmt/t:title", NS)), "authors": list(dict.fromkeys(authors)), "abstract": [text_of(p) for p in root.findall(".//t:profileDesc/t:abstract//t:p", NS)], "sections": sections, "refs": refs, "body_chars": size}


def parse_table(rows: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """One parsed row for each row of a table with a name and the document's text or bytes."""
    return _each(rows, name, content, parse, PARSED)


def _each(rows: DataFrame, name: str, content: str, of, fields: str) -> DataFrame:
    """A row for each document, which is parsed in a bounded slice."""

    def run(slices):
        for b in slices:
            yield [{"name": n} | of(c if c is not None else "") for n, c in zip(b["name"], b["content"])]

    return map_slices(rows.select(F.col(name).alias("name"), F.col(content).alias("content")), run, fields)


OUTLINE = "name string, status string, title string, persons array<string>, body string, heads array<string>, ref_titles array<string>"
#: The author paths that the quality gate looks at, in this order.
GATE_AUTHOR_PATHS = (".//t:fileDesc//t:analytic//t:persName", ".//t:fileDesc//t:author//t:persName")


def raw_text(node) -> str:
    """All text below a node, joined by blanks; white space stays."""
    return "" if node is None else " ".join(node.itertext()).strip()


def outline_of(content: str | bytes) -> dict:
    """What the quality gate judges: texts as they are, a head for each division (None where it has none)."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return {"status": "parse_error"}
    titles = [x for path in (".//t:fileDesc/t:titleStmt/t:title", ".//t:titleStmt/t:title") if (x := root.find(path, NS)) is not None]
    persons = next((p for path in GATE_AUTHOR_PATHS if (p := root.findall(path, NS))), [])
    body = root.find(".//t:body", NS)
    heads = [None if (h := div.find("t:head", NS)) is None else raw_text(h) for div in ([] if body is None else body.iterfind(".//t:div", NS))]
    refs = []
    for bib in root.findall(".//t:listBibl/t:biblStruct", NS):
        named = [x for level in "am" if (x := bib.find(f".//t:title[@level='{level}']", NS)) is not None]
        refs.append(raw_text(named[0]) if named else "")
    return {"status": "ok", "title": raw_text(titles[0]) if titles else "", "persons": [raw_text(x) for x in persons], "body": None if body is None else raw_text(body), "heads": heads, "ref_titles": refs}


def outline(rows: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """An outline for each document's text or bytes; see outline_of."""
    return _each(rows, name, content, outline_of, OUTLINE)


def read(spark: SparkSession, path: str, pattern: str = "*.tei.xml") -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return parse_table(rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def sections(parsed: DataFrame) -> DataFrame:
    return parsed.select("name", F.posexplode("sections").alias("i", "s")).select("name", "i", "s.*")


def paragraphs(parsed: DataFrame) -> DataFrame:
    return sections(parsed).select("name", "i", F.posexplode("paragraphs").alias("j", "content"))
