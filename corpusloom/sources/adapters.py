"""The logical tables of a scholarly corpus over the relational test tables.

Every table is a plan, not data: nothing runs until a query asks for it, and column pruning and filters reach the
Parquet scans.  A work is a document with the date of the order and the label of the same number; its sections are
its long lines, and so on.  Rules that give a section its class are a parameter.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_rule

MIN_CHARS = 30
SUBJECT_PREFIX = "CNPQ::"

#: Section rules that match lines of the test tables: (pattern over the lower-cased head, class), first match wins.
SECTION_RULES = [
    ("licen", "Conclusion"),
    ("^the ", "Introduction"),
    (" and ", "Results"),
    (" und ", "Methods"),
    (" que ", "RelatedWork"),
    (" la ", "Discussion"),
]

RHETORICAL_CLASSES = ["Results", "Conclusion", "Discussion"]


class Corpus:
    """works, subjects, creators, sections, paragraphs, refs, items, disc_sections and keywords of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, rules=None):
        self.spark, self.sf_dir, self.rules = spark, sf_dir, SECTION_RULES if rules is None else rules

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """What a document alone says of its work; no join."""
        return self.raw("documents").select("doc_id", F.concat(F.lit("11422/"), F.col("doc_id").cast("string")).alias("handle"), F.substring("text", 1, 60).alias("title"), "lang")

    @cached_property
    def works(self) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_lex"))
        q = self.raw("labels").select("doc_id", "quality")
        kind = F.when(F.col("quality") == 1, "DoctoralThesis").otherwise("MastersThesis")
        return self.texts.join(o, "doc_id", "left").join(q, "doc_id", "left").select("doc_id", "handle", "title", "date_lex", F.substring("date_lex", 1, 4).alias("year"), kind.alias("type"), "lang")

    @cached_property
    def creators(self) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
        c = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("creator"))
        return self.raw("documents").select("doc_id").join(o, "doc_id").join(c, "o_custkey").select("doc_id", "creator")

    @cached_property
    def subjects(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", F.col("source").alias("subject"))
        o = self.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit(SUBJECT_PREFIX), "o_orderpriority").alias("subject"))
        return d.unionByName(o.join(self.raw("documents").select("doc_id"), "doc_id"))

    @cached_property
    def lines(self) -> DataFrame:
        kept = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= MIN_CHARS)
        return self.raw("documents").select("doc_id", F.posexplode(kept).alias("i", "line"))

    @cached_property
    def sections(self) -> DataFrame:
        head = F.substring("line", 1, 40)
        return self.lines.select("doc_id", "i", head.alias("head"), first_rule(F.lower(head), self.rules, "Section").alias("class"), F.length("line").cast("long").alias("n_chars"))

    @cached_property
    def paragraphs(self) -> DataFrame:
        parts = F.filter(F.split("line", r"\. "), lambda x: F.length(x) >= MIN_CHARS)
        return self.lines.select("doc_id", "i", F.posexplode(parts).alias("j", "content"))

    @cached_property
    def refs(self) -> DataFrame:
        li = self.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k"), "l_partkey")
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_name").alias("ref_title"))
        return li.join(self.raw("documents").select("doc_id"), "doc_id", "left_semi").join(p, "l_partkey").select("doc_id", "k", "ref_title")

    @cached_property
    def items(self) -> DataFrame:
        c = self.raw("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("j"), "role", F.col("text").alias("content"))
        last = c.groupBy("doc_id").agg(F.max("j").alias("last"))
        kind = F.when(F.col("role") == "user", "claim").when(F.col("role") == "assistant", "contribution").otherwise("limitation")
        own = c.select("doc_id", F.expr("j div 2").alias("sec"), kind.alias("kind"), "j", "content")
        future = c.join(last, "doc_id").where("j = last").select("doc_id", F.expr("j div 2").alias("sec"), F.lit("future").alias("kind"), "j", "content")
        return own.unionByName(future)

    @cached_property
    def disc_sections(self) -> DataFrame:
        classes = F.array(*map(F.lit, RHETORICAL_CLASSES))
        at = self.raw("conversations").select(F.col("conv_id").alias("doc_id"), F.expr("turn div 2").alias("sec")).distinct()
        return at.select("doc_id", "sec", F.element_at(classes, (F.pmod(F.col("sec"), F.lit(len(RHETORICAL_CLASSES))) + 1).cast("int")).alias("class"))

    @cached_property
    def keywords(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("keyword")).distinct()


def sql_prefix(rules=None) -> str:
    """The same tables as common table expressions for DuckDB."""
    cases = " ".join(f"WHEN regexp_matches(lower(substr(line, 1, 40)), '{p}') THEN '{c}'" for p, c in (SECTION_RULES if rules is None else rules))
    classes = ", ".join(f"'{c}'" for c in RHETORICAL_CLASSES)
    return f"""
    WITH works AS (SELECT d.doc_id, '11422/' || d.doc_id AS handle, substr(d.text, 1, 60) AS title, strftime(o.o_orderdate, '%Y-%m-%d') AS date_lex,
                          strftime(o.o_orderdate, '%Y') AS year, CASE WHEN l.quality = 1 THEN 'DoctoralThesis' ELSE 'MastersThesis' END AS type, d.lang
                   FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
    creators AS (SELECT d.doc_id, c.c_name AS creator FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id JOIN customer c ON c.c_custkey = o.o_custkey),
    subjects AS (SELECT doc_id, source AS subject FROM documents UNION ALL
                 SELECT d.doc_id, '{SUBJECT_PREFIX}' || o.o_orderpriority FROM orders o JOIN documents d ON d.doc_id = o.o_orderkey),
    lines AS (SELECT doc_id, u.i - 1 AS i, u.line FROM documents d, unnest(list_filter(string_split(d.text, chr(10)), lambda x: length(x) >= {MIN_CHARS})) WITH ORDINALITY AS u(line, i)),
    sections AS (SELECT doc_id, i, substr(line, 1, 40) AS head, CASE {cases} ELSE 'Section' END AS class, length(line) AS n_chars FROM lines),
    paragraphs AS (SELECT doc_id, l.i, u.j - 1 AS j, u.content FROM lines l, unnest(list_filter(string_split(l.line, '. '), lambda x: length(x) >= {MIN_CHARS})) WITH ORDINALITY AS u(content, j)),
    refs AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, p_brand || ' ' || p_name AS ref_title FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT doc_id FROM documents)),
    items AS (SELECT conv_id AS doc_id, turn // 2 AS sec, CASE role WHEN 'user' THEN 'claim' WHEN 'assistant' THEN 'contribution' ELSE 'limitation' END AS kind, turn AS j, text AS content FROM conversations
              UNION ALL SELECT c.conv_id, c.turn // 2, 'future', c.turn, c.text FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) m ON m.conv_id = c.conv_id AND c.turn = m.last),
    disc_sections AS (SELECT DISTINCT conv_id AS doc_id, turn // 2 AS sec, [{classes}][(turn // 2) % {len(RHETORICAL_CLASSES)} + 1] AS class FROM conversations),
    keywords AS (SELECT DISTINCT user_id AS doc_id, event_type AS keyword FROM events)
    """
