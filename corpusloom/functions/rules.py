"""Rule tables of theses and what is decided by them: classes of sections, target sections, keywords, abstracts.

Patterns hold for lower-cased text without blanks at its ends and see accents as letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.records import abstract_paragraph, lowest_tier
from .text import any_rule, first_casing

#: Patterns over a section's head and its class; the first that matches wins.
SECTION_CLASSES = [
    (r"\b(introduc|introdu[çc])", "deo:Introduction"),
    (r"\b(abstract|resumo|sum[aá]rio\s+em\s+ingl)", "doco:Abstract"),
    (r"\b(conclus|conclud|encerr)", "deo:Conclusion"),
    (r"\bconsidera[çc][õo]es\s*finais", "deo:Conclusion"),
    (r"\bfinal\s*(remarks?|considerations?|thoughts?)?$", "deo:Conclusion"),
    (r"\b(related.work|trabalho.relacion|literatura|revis[ãa]o|review)", "deo:RelatedWork"),
    (r"\b(method|metodolog|materiai|materials|proposta|arquitetura)", "deo:Methods"),
    (r"\b(experiment|experimen|avalia|evaluation|result|resultado)", "deo:Results"),
    (r"\b(discuss|an[áa]lise|analysis)", "deo:Discussion"),
    (r"\b(background|fundament|conceitos\s+b[áa]sicos|theoretical|referencial)", "deo:Background"),
    (r"\b(acknowledgement|agradec)", "deo:Acknowledgements"),
    (r"^referên[çc]ias\b", "doco:ListOfReferences"),
    (r"\b(bibliograf|works.cited|referências\s+bibliogr)", "doco:ListOfReferences"),
    (r"\b(referenc)", "doco:ListOfReferences"),
    (r"\b(appendix|ap[êe]ndice|anexo)", "doco:Appendix"),
    (r"^sugest[õo]es\b", "deo:FutureWork"),
    (r"^\s*[IVX]+[\.\s\-]+.*\b(introduc|introdu[çc])", "deo:Introduction"),
    (r"^\s*[IVX]+[\.\s\-]+.*\b(conclus|considera)", "deo:Conclusion"),
    (r"^\s*[IVX]+[\.\s\-]+.*\b(result|avalia|experiment)", "deo:Results"),
    (r"^\s*[IVX]+[\.\s\-]+.*\b(discuss|an[áa]lise)", "deo:Discussion"),
    (r"^\s*[IVX]+[\.\s\-]+.*\b(method|metodolog)", "deo:Methods"),
    (r"^\s*[IVX]+[\.\s\-]+.*\b(referenc|bibliograf)", "doco:ListOfReferences"),
    (r"^\s*[IVX]+[\.\s\-]+sugest[õo]es\b", "deo:FutureWork"),
    (r"^\s*\d+[\.\s\-]+.*\b(introduc|introdu[çc])", "deo:Introduction"),
    (r"^\s*\d+[\.\s\-]+.*\b(conclus|considera|final)", "deo:Conclusion"),
    (r"^\s*\d+[\.\s\-]+.*\b(result|avalia|experiment)", "deo:Results"),
    (r"^\s*\d+[\.\s\-]+.*\b(discuss|an[áa]lise)", "deo:Discussion"),
    (r"^\s*\d+[\.\s\-]+.*\b(method|metodolog|proposta)", "deo:Methods"),
    (r"^\s*cap[íi]tulo\s+\d+.*\b(conclus|considera)", "deo:Conclusion"),
    (r"^\s*cap[íi]tulo\s+\d+.*\b(result|avalia)", "deo:Results"),
]
NO_CLASS = "doco:Section"

#: Heads of sections worth analysing, and how long such a section is at least.
TARGET_HEADS = [
    r"\bconclu[sz]", r"\bresult[ao]", r"\bdiscus[sz]", r"\bcontribu", r"\bconsider[ao]", r"\bfinal\s*(remarks?)?",
    r"\bsummar[yi]", r"\brecomend", r"\bencerr", r"\bfinal\s+chapter", r"^[IVX\d]+[\.\-\s]+.*\bconclu[sz]",
    r"^[IVX\d]+[\.\-\s]+.*\bresult[ao]", r"^[IVX\d]+[\.\-\s]+.*\bdiscus[sz]", r"^cap[íi]tulo\s+\d+.*\bconclu[sz]",
    r"^cap[íi]tulo\s+\d+.*\bresult[ao]",
]
TARGET_CHARS = 100

#: Phrases by which a section without a telling head is known as a conclusion.
CONTENT_PHRASES = [
    r"\bconclui-se\s+que\b",
    r"\bpode-se\s+concluir\b",
    r"\bneste\s+(trabalho|estudo|artigo)[^.]{0,40}(apresentou|propôs|desenvolveu|demonstrou|foi|foram)\b",
    r"\bnesta\s+(dissertação|tese)[^.]{0,40}(foi|foram|apresentou|propôs)\b",
    r"\bos\s+resultados\s+(obtidos|mostram|indicam|demonstram|confirmam|sugerem)\b",
    r"\bfoi\s+(possível|demonstrado|verificado|comprovado)\s+que\b",
    r"\bcomo\s+conclusão\b",
    r"\bin\s+this\s+(work|thesis|paper|study)[^.]{0,40}(proposed|presented|demonstrated|showed)\b",
    r"\bthe\s+(proposed|present)\s+(work|method|approach)\b",
    r"\bthe\s+results?\s+(show|indicate|demonstrate|confirm|suggest)\b",
    r"\bwe\s+(conclude|showed|demonstrated|proposed|presented)\b",
    r"\bit\s+was\s+(shown|demonstrated|verified|confirmed)\s+that\b",
    r"\bfuture\s+work\s+(includes|will|should|may)\b",
    r"\btrabalhos?\s+futuros?\s+(incluem|incluir[áa]|podem|ser[aã]o)\b",
    r"\bsugest[õo]es\s+para\s+(trabalhos|pesquisas)\s+futuros?\b",
    r"\bperspectivas?\s+de\s+trabalho\s+futuro\b",
]
#: Where a section was found; classes of the last fallback.
FOUND_BY_HEAD, FOUND_BY_CONTENT, FOUND_BY_CLASS, UNTITLED = "tei", "tei_content_search", "ttl_fallback", "[sem título]"
FALLBACK_CLASSES = ["deo:Conclusion", "deo:Results", "deo:Discussion"]

#: Words that are no keywords, the shortest keyword and how many are kept.
KEYWORD_STOP = [
    "results", "resultados", "conclusion", "conclusão", "conclusões", "methodology", "metodologia", "simulation", "simulação",
    "simulações", "research", "pesquisa", "study", "estudos", "analysis", "análise", "work", "trabalho", "method", "método",
    "approach", "abordagem", "future work", "trabalhos futuros", "limitations", "limitações", "contribution", "contribuição",
    "contribuições", "introduction", "introdução", "discussion", "discussão", "overview", "summary", "resumo", "model",
    "modelo", "technique", "técnica", "data", "dados", "system", "sistema", "process", "processo", "seção 6.5",
    "análise da tabela", "melhores resultados dos experimentos", "indústria", "comunidade acadêmica", "conhecimento geral",
    "oportunidades de trabalho futuro", "prática",
]
KEYWORD_CHARS, KEYWORDS = 4, 5

#: What a paragraph of an abstract doesn't open with, and what it opens with.
ABSTRACT_SKIP = ["agradeç", "agradecimento", "acknowledge", "dedico", "dedicatória", "à minha", "ao meu", "lista de ", "sumário", "índice geral"]
ABSTRACT_MARKERS = ["resumo", "abstract", "neste trabalho", "this work", "this paper", "este trabalho", "o presente", "this dissertation"]

#: Rhetorical types and their classes.
RHETORICAL = {"conclusion": "deo:Conclusion", "results": "deo:Results", "discussion": "deo:Discussion", "contribution": "deo:Background"}


def _plain(x: Column) -> Column:
    return F.trim(F.lower(F.coalesce(x, F.lit(""))))


def section_class(head: Column) -> Column:
    """Class of a section by its head."""
    out, text = None, _plain(head)
    for pattern, name in SECTION_CLASSES:
        hit = text.rlike("(?iuU)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(NO_CLASS)


def is_target_head(head: Column) -> Column:
    return any_rule(_plain(head), TARGET_HEADS, "(?iuU)")


def concludes(text: Column) -> Column:
    return any_rule(F.coalesce(text, F.lit("")), CONTENT_PHRASES, "(?iuU)")


def rhetorical_class(kind: Column) -> Column:
    """Class of an analysed section; unknown types are plain sections."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RHETORICAL.items() for x in kv))[F.lower(F.coalesce(kind, F.lit("")))], F.lit(NO_CLASS))


def target_sections(sections: DataFrame, key: str = "doc_id", head: str = "head", text: str = "text", kind: str | None = "class") -> DataFrame:
    """The sections of each document worth analysing, with a source: those known by their head; only where there are
    none, those known by their content; only where there are none of these either, those of a telling class."""
    long = F.length(F.coalesce(F.col(text), F.lit(""))) >= TARGET_CHARS
    tier = F.when(long & is_target_head(F.col(head)), 1).when(long & concludes(F.col(text)), 2)
    if kind is not None:
        tier = tier.when(F.col(kind).isin(*FALLBACK_CLASSES), 3)
    found = lowest_tier(sections.withColumn("tier", tier).where("tier is not null"), key, "tier")
    named = F.when((F.col("tier") == 2) & (F.coalesce(F.col(head), F.lit("")) == ""), UNTITLED).otherwise(F.col(head))
    source = F.when(F.col("tier") == 1, FOUND_BY_HEAD).when(F.col("tier") == 2, FOUND_BY_CONTENT).otherwise(FOUND_BY_CLASS)
    return found.withColumn(head, named).withColumn("source", source).drop("tier")


def keywords(values: Column) -> Column:
    """Keywords worth keeping: no stop word, in their first casing, KEYWORDS at most."""
    return first_casing(values, KEYWORD_STOP, KEYWORD_CHARS, KEYWORDS)


def abstract_of(paragraphs: Column) -> Column:
    """The paragraph of an abstract that says what the work is about; the empty text where none does."""
    return F.coalesce(abstract_paragraph(paragraphs, ABSTRACT_SKIP, ABSTRACT_MARKERS), F.lit(""))


#: How much of a section's text a prompt holds, in an analysis and in a comparison of models.
ANALYSIS_CHARS, COMPARISON_CHARS = 6000, 9000


def prompt(title: Column, head: Column, text: Column, chars: int = ANALYSIS_CHARS) -> Column:
    """What is asked of a language model about one section; answers are JSON with the fields of an analysed section."""
    asked = F.lit('Answer with one JSON object: {"claims": [], "contributions": [], "limitations": [], "future_work": [], "keywords_inferred": [], "rhetorical_type": ""}')
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit('Thesis: "'), blank(title), F.lit('"\nSection: "'), blank(head), F.lit('"\n\n'), F.substring(blank(text), 1, chars), F.lit("\n\n"), asked)


def better_title(parsed: Column, manifest: Column, is_fake) -> Column:
    """The manifest's title where the parsed one is missing or fake and the manifest has one."""
    named = F.trim(F.coalesce(manifest, F.lit("")))
    return F.when((named != "") & ((F.coalesce(parsed, F.lit("")) == "") | is_fake(parsed)), named).otherwise(F.coalesce(parsed, F.lit("")))


