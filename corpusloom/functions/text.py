"""Scalar functions and rule-based text classifiers as native column expressions.

Patterns that must see accents as letters carry (?iu) or (?U); see each rule table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(x: Column) -> Column:
    """Runs of any white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def xml_text(x: Column, path: str) -> Column:
    """All text below the nodes of a path of an XML document, joined by blanks; names stand without their namespace."""
    return F.trim(F.array_join(F.xpath(x, F.lit(path + "//text()")), " "))


def stem(handle: Column) -> Column:
    """File stem of a handle: every slash becomes an underscore."""
    return F.replace(handle, F.lit("/"), F.lit("_"))


def handle_of(stem_: Column) -> Column:
    """Handle of a file stem: only the first underscore becomes a slash."""
    return F.regexp_replace(stem_, "^([^_]*)_", "$1/")


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4)


def first_rule(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Class of the first pattern that matches."""
    out = None
    for pattern, name in rules:
        out = F.when(x.rlike(pattern), name) if out is None else out.when(x.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


#: What a letter matches besides its two cases where Unicode decides on case.
_FOLDS = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _opens_with(pattern: str) -> str | None:
    """The letter that a pattern of the shape \\bletter... has to open with; None for any other shape."""
    m = re.match(r"\\b([a-z])(?![?*{|])", pattern)
    depth, bare = 0, re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    for x in bare:
        depth += (x == "(") - (x == ")")
        if x == "|" and not depth:
            return None
    return m[1] if m else None


def alternatives(patterns: list[str]) -> str:
    """A pattern that is found where any of them is.  Those that open with a letter at a word's border share one look at
    the letter and one at the border, which is what a long text's time goes to."""
    letters = {p: x for p in patterns if (x := _opens_with(p))}
    rest = [f"(?:{p})" for p in patterns if p not in letters]
    if not letters:
        return "|".join(rest)
    first = "".join(x + x.upper() + _FOLDS.get(x, "") for x in sorted(set(letters.values())))
    return "|".join([rf"(?-iuU:(?=[{first}]))\b(?:" + "|".join(p[2:] for p in letters) + ")", *rest])


def any_rule(x: Column, patterns: list[str], flags: str = "(?iu)") -> Column:
    return x.rlike(flags + alternatives(patterns))


def contains_any(x: Column, terms: list[str], lower: bool = True) -> Column:
    x = F.lower(x) if lower else x
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(x, F.lit(term))
    return out


def class_ratio(x: Column, keep: str) -> Column:
    """Share of the characters in a class; 0 for an empty text."""
    return F.length(F.regexp_replace(x, f"[^{keep}]", "")) / F.greatest(F.length(x), F.lit(1))


def alpha_ratio(x: Column) -> Column:
    return class_ratio(x, r"\p{L}")


def digit_ratio(x: Column) -> Column:
    return class_ratio(x, r"\p{Nd}")


def garbage_ratio(x: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space; an empty text is all garbage."""
    return F.when(F.length(x) == 0, 1.0).otherwise(1 - F.length(F.regexp_replace(x, r"(?U)[^\p{L}\p{N}\s]", "")) / F.length(x))


#: When a title is noise, and the bounds of its length.
NOISE_TITLE = [
    r"^lista\s+de\s+(figura|tabela|quadro|abreviatura|símbolo|sigla|algoritmo)",
    r"^list\s+of\s+(figure|table|algorithm|abbreviation|symbol)",
    r"^(sumário|índice|contents?|table\s+of\s+contents?)$",
    r"^(agradecimento|acknowledgement|dedicatória|dedico\s)",
    r"^(à|ao|aos|às)\s+\w",
    r"^orientador",
    r"^resumo\s+da\s+(dissertação|tese)",
    r"^(abstract|resumo)\s*$",
    r"^capítulo\s+[ivxlcd\d]",
    r"^chapter\s+[ivxlcd\d]",
    r"\b(ufrj|coppe)\b.*\bparte\s+dos\s+requisitos",
    r"pela\s+orientação|pelo\s+estímulo",
    r"^(conclus|result|discuss|introduç|métod|referênc)",
    r"^(introdução|conclusion|results?|discussion|methods?)$",
    r"[•|]{3,}",
    r"\.{5,}",
]
SHORT_TITLE, LONG_TITLE, TITLE_ALPHA = 5, 250, 0.4

#: Titles, and authors, that stem from a table of contents or a heading.
HEADING_TITLE = [r"•{3,}", r"-{5,}", r"\.{5,}", r"^\s*cap[íi]tulo\s+[IVX\d]", r"\d{2,}\s*$"]
HEADING_AUTHOR = [r"•{2,}", r"-{3,}", r"^(cap[íi]tulo|seção|parte|anexo|ap[êe]ndice)\s", r"\d{2,}$", r"^\W+$", r"^[A-Z][a-z]*(\s+[A-Z][a-z]*){3,}"]

#: Titles that are really thanks or a dedication.
THANKS_TITLE = ["ao prof", "à prof", "ao dr", "à dr", "orientador desta", "minha gratidão", "meus sinceros agradecimentos", "dedico esta", "dedico este", "dedicatória", "a todos os", "a todas as", "ao corpo docente", "aos professores"]

#: Phrases of items that say nothing, and the length under which an item is generic.
GENERIC = [
    "this chapter presents", "este capítulo apresenta", "this section discusses", "esta seção discute", "future work will",
    "trabalhos futuros irão", "as presented in", "conforme apresentado", "this work aims", "este trabalho tem como objetivo",
    "the results show that the", "os resultados mostram que o", "in this thesis", "nesta dissertação", "further research is needed",
    "mais pesquisas são necessárias", "it was found that", "verificou-se que", "the study shows", "o estudo mostra",
    "the proposed approach", "a abordagem proposta",
]
GENERIC_CHARS = 40


def is_heading_title(x: Column) -> Column:
    return (F.length(x) > LONG_TITLE) | any_rule(x, HEADING_TITLE)


def is_noise_title(x: Column) -> Column:
    t = F.trim(F.coalesce(x, F.lit("")))
    return (t == "") | (F.length(t) < SHORT_TITLE) | (F.length(t) > LONG_TITLE) | (alpha_ratio(t) < TITLE_ALPHA) | any_rule(t, NOISE_TITLE)


def is_thanks_title(x: Column) -> Column:
    return contains_any(x, THANKS_TITLE)


def is_heading_author(x: Column) -> Column:
    return any_rule(x, HEADING_AUTHOR, "(?iuU)")


def is_generic(x: Column, phrases: list[str] | None = None, chars: int = GENERIC_CHARS) -> Column:
    return (F.length(x) < chars) | contains_any(x, GENERIC if phrases is None else phrases)


def work_type(types: Column, mapping: dict[str, str], default: str) -> Column:
    """Type of the first value that holds a key of the ordered mapping."""
    def one(t):
        out = None
        for key, name in mapping.items():
            hit = F.contains(F.lower(t), F.lit(key))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return F.coalesce(F.try_element_at(F.filter(F.transform(types, one), lambda x: x.isNotNull()), F.lit(1)), F.lit(default))


#: Words in a type and the work's type.
WORK_TYPES = {"tese": "DoctoralThesis", "doutorado": "DoctoralThesis", "doctoral": "DoctoralThesis", "dissertação": "MastersThesis", "mestrado": "MastersThesis", "masters": "MastersThesis"}


def date_literal(x: Column) -> Column:
    """struct(lex, kind): a date in its shape, else a year of four digits, else empty; no calendar check."""
    c = F.trim(F.substring(x, 1, 10))
    dated = (F.length(c) == 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-")
    y = F.substring(c, 1, 4)
    year = (F.length(y) == 4) & y.rlike("^[0-9]{4}$")
    lex = F.when(dated, c).when(year, y).otherwise("")
    return F.struct(lex.alias("lex"), F.when(dated, "date").when(year, "gYear").otherwise("").alias("kind"))


def repair_json(x: Column) -> Column:
    """A cut-off JSON object made whole: fences and text before the first brace go, open brackets, then braces close."""
    # patterns only where there is something for them: a whole answer needs none of these
    t = F.trim(x)
    t = F.when(F.contains(t, F.lit("```")), F.regexp_replace(t, r"^```(?:json)?\s*|\s*```$", "")).otherwise(t)
    body = F.when(F.startswith(t, F.lit("{")), t).otherwise(F.regexp_replace(t, r"^[^{]*", ""))
    count = lambda c: F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit("")))
    missing = lambda a, b: F.greatest(count(a) - count(b), F.lit(0))
    return F.concat(body, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}")))


def first_casing(values: Column, stop: list[str], min_chars: int, most: int) -> Column:
    """Trimmed values of min_chars or more outside the stop list, one for each lower-cased form in order, most at most."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (F.length(v) >= min_chars) & ~F.lower(v).isin(*stop) if stop else F.length(v) >= min_chars)
    low = F.transform(kept, F.lower)
    once = F.filter(F.arrays_zip(kept.alias("v"), low.alias("l"), F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))).alias("p")), lambda z: F.array_position(low, z["l"]) == z["p"])
    return F.slice(F.transform(once, lambda z: z["v"]), 1, most)


def floor_percent(a: Column, n: Column) -> Column:
    return F.floor(100 * a / F.greatest(n, F.lit(1))).cast("long")


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, the larger parts left out while they are zero."""
    s = F.floor(seconds).cast("int")
    h, m, rest = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(s >= 3600, F.format_string("%dh %dm %ds", h, m, rest)).when(s >= 60, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))
