"""Analysis of sections by a language model or by rules, from prompts to one row per document.

A client is a function from a prompt to an answer, made once per task; answers are values, so a failed call is a
section without an analysis and not the job's end.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import is_thanks_title, repair_json
from ..sources.services import with_client

#: The lists of an analysis and the states of a document.
LISTS = ["claims", "contributions", "limitations", "future_work", "keywords_inferred"]
OK, NO_SECTIONS, FAILED = "ok", "no_target_sections", "llm_failed"
ANSWER = "claims array<string>, contributions array<string>, limitations array<string>, future_work array<string>, keywords_inferred array<string>, rhetorical_type string"


def parse_answer(answer: Column) -> Column:
    """An answer as a struct, its keywords cleaned; null where it holds no JSON object, whole or cut off."""
    whole = repair_json(answer)
    got = F.from_json(whole, ANSWER)
    listed = lambda k: F.coalesce(got[k], F.array().cast("array<string>"))
    fields = [(rules.keywords(listed(k)) if k == "keywords_inferred" else listed(k)).alias(k) for k in LISTS]
    return F.when(F.try_parse_json(whole).isNotNull(), F.struct(*fields, F.coalesce(got["rhetorical_type"], F.lit("")).alias("rhetorical_type")))


def analyze(documents: DataFrame, sections: DataFrame, make: Callable[[], Callable[[str], str]] | None = None, concurrency: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, status, doc_title, sections) of every document.

    documents: key, title and manifest_title; sections: key, i, head, text and class.  The target sections are asked for
    one by one; a document is ok if one of its sections was analysed, failed if none of those asked for was, and without
    target sections else.  make gives the client; by default rules answer."""
    titled = documents.select(key, rules.better_title(F.col("title"), F.col("manifest_title"), is_thanks_title).alias("doc_title"))
    asked = rules.target_sections(sections, key, "head", "text", "class").join(titled, key)
    asked = asked.select(key, "i", "head", F.length("text").alias("text_length"), "source", rules.prompt(F.col("doc_title"), F.col("head"), F.col("text")).alias("prompt"))
    asked = asked.withColumn("_at", F.to_json(F.struct(key, "i", "head", "text_length", "source")))
    answers = with_client(asked, "_at", "prompt", make or (lambda: rule_answer), concurrency)
    kinds = f"`{key}` {sections.schema[key].dataType.simpleString()}, i {sections.schema['i'].dataType.simpleString()}, head string, text_length int, source string"
    read = answers.select(F.from_json("_at", kinds).alias("at"), parse_answer(F.col("answer")).alias("a")).select("at.*", "a")
    one = F.struct(F.col("i").cast("int").alias("section_index"), F.col("head").alias("section_head"), "text_length", "source", *(F.col(f"a.{k}").alias(k) for k in LISTS), F.col("a.rhetorical_type").alias("rhetorical_type"))
    done = read.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), one))).alias("sections"))
    out = titled.join(done, key, "left")
    status = F.when(F.col("sections").isNull(), NO_SECTIONS).when(F.size("sections") == 0, FAILED).otherwise(OK)
    empty = F.array().cast(done.schema["sections"].dataType)
    return out.select(key, status.alias("status"), "doc_title", F.coalesce("sections", empty).alias("sections"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_RULES = [("limitations", re.compile(r"limita|restri|drawback", re.I)), ("future_work", re.compile(r"futur", re.I)), ("contributions", re.compile(r"contribu|propos|desenvolv|develop|implement", re.I)), ("claims", re.compile(r"result|mostr|show|conclu|\d", re.I))]
_MOST = {"claims": 5, "contributions": 3, "limitations": 3, "future_work": 3}


def rule_answer(prompt: str) -> str:
    """What a model answers, by rules: each sentence goes to the first list whose words it holds; the section's most
    frequent long words are keywords; the head tells the rhetorical type.  The same prompt gives the same answer."""
    head, _, body = prompt.partition("\n\n")
    body = body.rpartition("\n\n")[0]
    out: dict = {k: [] for k in LISTS}
    for sentence in _SENTENCE.split(body):
        name = next((k for k, words in _RULES if words.search(sentence)), None)
        if name and len(out[name]) < _MOST[name] and len(sentence.strip()) >= 10:
            out[name].append(sentence.strip())
    words = Counter(w for w in re.findall(r"[^\W\d_]{6,}", body.lower()))
    out["keywords_inferred"] = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]]
    named = head.rpartition("Section: ")[2].lower()
    out["rhetorical_type"] = next((k for k, part in (("conclusion", "conclu"), ("results", "result"), ("discussion", "discuss"), ("contribution", "contribu")) if part in named), "mixed")
    return json.dumps(out, ensure_ascii=False)


def enrich(analysed: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The analysed documents as the logical tables items, disc_sections and keywords, which the graph is built from.

    A section's number is its place among the analysed ones; items count from 0 within their list, short ones included."""
    ok = analysed.where(F.col("status") == OK).select(F.col(key).alias("doc_id"), F.posexplode("sections").alias("sec", "s"))
    kinds = {"claims": "claim", "contributions": "contribution", "limitations": "limitation", "future_work": "future"}
    each = F.array(*(F.struct(F.lit(v).alias("kind"), F.col(f"s.{k}").alias("texts")) for k, v in kinds.items()))
    lists = ok.select("doc_id", "sec", F.explode(each).alias("e")).select("doc_id", "sec", "e.kind", F.posexplode("e.texts").alias("j", "content"))
    sections = ok.select("doc_id", "sec", rules.rhetorical_class(F.col("s.rhetorical_type")).alias("class"))
    words = ok.select("doc_id", F.explode("s.keywords_inferred").alias("keyword")).distinct()
    return lists, sections, words


#: Why no section of a document can be analysed.
NO_HEADS, NO_TARGET_HEADS = "TEI sem nenhuma seção com head", "TEI tem heads mas nenhum bate nos TARGET_PATTERNS"
NO_GRAPH, NO_GRAPH_SECTIONS, NO_GRAPH_TEXT, NO_GRAPH_LINKS = "TTL file not found", "no deo:Conclusion/Results/Discussion in TTL", "DEO seções existem mas parágrafos sem c4o:hasContent", "DEO existe mas sem parágrafos linked"


def diagnose_sections(documents: DataFrame, sections: DataFrame, graph_sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tei_ok, graph_ok, causes) of every document: whether its parsed heads, or else its sections in the graph, give
    anything to analyse, and why not.

    sections: key, head; graph_sections: key, class, n_paragraphs, n_with_content."""
    head = F.coalesce(F.col("head"), F.lit(""))
    heads = sections.groupBy(key).agg(F.count_if(head != "").alias("n_heads"), F.count_if((head != "") & rules.is_target_head(head)).alias("n_target"))
    telling = F.col("class").isin(*rules.FALLBACK_CLASSES)
    found = graph_sections.groupBy(key).agg(F.count("*").alias("n"), F.count_if(telling).alias("n_deo"), F.count_if(telling & (F.col("n_paragraphs") > 0)).alias("n_linked"), F.count_if(telling & (F.col("n_with_content") > 0)).alias("n_text"))
    both = documents.select(key).join(heads, key, "left").join(found, key, "left").fillna(0, ["n_heads", "n_target", "n_deo", "n_linked", "n_text"])
    tei = F.col("n_target") > 0
    graph = F.col("n_text") > 0
    first = F.when(F.col("n_heads") == 0, NO_HEADS).otherwise(NO_TARGET_HEADS)
    second = F.when(F.col("n").isNull(), NO_GRAPH).when(F.col("n_deo") == 0, NO_GRAPH_SECTIONS).when(F.col("n_linked") > 0, NO_GRAPH_TEXT).otherwise(NO_GRAPH_LINKS)
    return both.select(key, tei.alias("tei_ok"), graph.alias("graph_ok"), F.when(~tei & ~graph, F.array(first, second)).otherwise(F.array().cast("array<string>")).alias("causes"))


def cause_counts(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.select(F.explode("causes").alias("cause")).groupBy("cause").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause")
