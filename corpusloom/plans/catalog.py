"""The catalogue of corpus queries as declarative plans over the logical tables.

Each entry has a plan and, for DuckDB, SQL over the same tables.  Search terms, thresholds and limits are arguments;
the defaults of the SQL are those of DEFAULTS, terms that occur in the test tables.  Every limited query has a total
order, so that its rows are the same on every run.  The deliberate readings: titles group, not works, where the query
says so; joins keep the multiplicity of solutions; counting a work's items ignores missing ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..operators.records import shuffled
from ..sources import sinks
from ..sources.adapters import SUBJECT_PREFIX, Corpus, sql_prefix

#: Terms that occur in the test tables, per role.
TERMS = {"text": "the", "claim": "and", "topic_a": ["src1", "priority"], "topic_b": ["high"], "area": "urgent", "keyword": "c", "markers": ["the ", "und ", "que "]}

RHETORICAL = ["Introduction", "Methods", "Results", "Conclusion", "Discussion", "RelatedWork"]
DISCOURSE_SQL = ", ".join(f"'{x}'" for x in RHETORICAL)

CATALOG: dict[str, tuple[Callable[..., DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        CATALOG[name] = (f, sql)
        return f

    return add


def n(name: str = "*", alias: str = "total"):
    return F.count(name).alias(alias)


def top(df: DataFrame, count: str, limit: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(count), *ties).limit(limit)


def item_texts(c: Corpus, kind: str) -> DataFrame:
    return c.items.where(F.col("kind") == kind).select("doc_id", "sec", "j", "content")


def titled(c: Corpus, longer: int = 20) -> DataFrame:
    return c.works.where(F.length("title") > longer)


@query("S01", "SELECT (SELECT count(DISTINCT doc_id) FROM works) AS documentos, (SELECT count(*) FROM sections) AS secoes, (SELECT count(*) FROM paragraphs) AS paragrafos")
def overview(c: Corpus) -> DataFrame:
    """Distinct works, sections and paragraphs; three counts, no join of the three levels."""
    w = c.works.agg(F.count_distinct("doc_id").alias("documentos"))
    s = c.sections.agg(F.count("*").alias("secoes"))
    p = c.paragraphs.agg(F.count("*").alias("paragrafos"))
    one = lambda x: x.withColumn("_k", F.lit(1))
    return one(w).join(one(s), "_k").join(one(p), "_k").drop("_k")


@query("S02", "SELECT type AS tipo, count(*) AS total FROM works GROUP BY type UNION ALL SELECT 'Work', count(*) FROM works")
def types(c: Corpus) -> DataFrame:
    return c.works.select(F.explode(F.array("type", F.lit("Work"))).alias("tipo")).groupBy("tipo").agg(n())


@query("R02", "SELECT type AS tipo, count(*) AS total FROM works GROUP BY type")
def types_only(c: Corpus) -> DataFrame:
    return c.works.groupBy(F.col("type").alias("tipo")).agg(n())


@query("S03", f"SELECT class AS tipo, count(*) AS total FROM (SELECT class FROM sections UNION ALL SELECT class FROM disc_sections) WHERE class IN ({DISCOURSE_SQL}) GROUP BY class")
def rhetorical_histogram(c: Corpus) -> DataFrame:
    """Sections and analysed sections by rhetorical class."""
    both = c.sections.select("class").unionByName(c.disc_sections.select("class"))
    return both.where(F.col("class").isin(*RHETORICAL)).groupBy(F.col("class").alias("tipo")).agg(n())


def _top_subjects(limit: int):
    def plan(c: Corpus, limit: int = limit) -> DataFrame:
        return top(c.subjects.groupBy(F.col("subject").alias("keyword")).agg(n(alias="freq")), "freq", limit, "keyword")

    return plan


for _id, _n in (("S04", 20), ("R05", 10)):
    CATALOG[_id] = (_top_subjects(_n), f"SELECT subject AS keyword, count(*) AS freq FROM subjects GROUP BY subject ORDER BY freq DESC, keyword LIMIT {_n}")


@query("S05", "SELECT w.title AS titulo, p.content AS paragrafo FROM sections s JOIN paragraphs p USING (doc_id, i) JOIN works w USING (doc_id) WHERE s.class = 'Conclusion' AND contains(lower(p.content), 'licen') ORDER BY titulo, paragrafo, w.doc_id LIMIT 10")
def paragraphs_with(c: Corpus, term: str = "licen", kind: str = "Conclusion", limit: int = 10) -> DataFrame:
    s = c.sections.where(F.col("class") == kind).select("doc_id", "i")
    p = c.paragraphs.where(F.contains(F.lower("content"), F.lit(term)))
    return s.join(p, ["doc_id", "i"]).join(c.works, "doc_id").select(F.col("title").alias("titulo"), F.col("content").alias("paragrafo"), "doc_id").orderBy("titulo", "paragrafo", "doc_id").limit(limit).drop("doc_id")


@query("S06", "SELECT year AS ano, count(*) AS total FROM works WHERE year BETWEEN '1970' AND '2030' GROUP BY year")
def per_year(c: Corpus, low: str = "1970", high: str = "2030") -> DataFrame:
    return c.works.where(F.col("year").between(low, high)).groupBy(F.col("year").alias("ano")).agg(n())


@query("R04", "SELECT year AS ano, count(*) AS total FROM works WHERE length(year) = 4 GROUP BY year")
def per_full_year(c: Corpus) -> DataFrame:
    return c.works.where(F.length("year") == 4).groupBy(F.col("year").alias("ano")).agg(n())


def _per_title(kind: str, column: str, limit: int, extra=None):
    def plan(c: Corpus, limit: int = limit) -> DataFrame:
        found = titled(c).join(item_texts(c, kind), "doc_id").groupBy(F.col("title").alias("titulo")).agg(n(alias=column))
        found = top(found, column, limit, "titulo")
        return extra(found) if extra else found

    return plan


def _per_title_sql(kind: str, column: str, limit: int) -> str:
    return f"SELECT title AS titulo, count(*) AS {column} FROM works JOIN items USING (doc_id) WHERE kind = '{kind}' AND length(title) > 20 GROUP BY title ORDER BY {column} DESC, titulo LIMIT {limit}"


CATALOG["S07"] = (_per_title("claim", "n_claims", 15), _per_title_sql("claim", "n_claims", 15))
CATALOG["S14"] = (_per_title("limitation", "n_limitacoes", 15), _per_title_sql("limitation", "n_limitacoes", 15))
CATALOG["R13"] = (
    _per_title("limitation", "n_limitacoes", 5, lambda d: d.withColumn("titulo", F.substring("titulo", 1, 80))),
    f"SELECT substr(titulo, 1, 80) AS titulo, n_limitacoes FROM ({_per_title_sql('limitation', 'n_limitacoes', 5)})",
)


@query("S08", "SELECT title AS titulo, content AS claim FROM works JOIN items USING (doc_id) WHERE kind = 'claim' AND contains(lower(content), 'and') ORDER BY titulo, claim, doc_id, j LIMIT 20")
def claims_with(c: Corpus, term: str = TERMS["claim"], limit: int = 20) -> DataFrame:
    found = item_texts(c, "claim").where(F.contains(F.lower("content"), F.lit(term))).join(c.works, "doc_id")
    return found.select(F.col("title").alias("titulo"), F.col("content").alias("claim"), "doc_id", "j").orderBy("titulo", "claim", "doc_id", "j").limit(limit).drop("doc_id", "j")


@query("S09", "SELECT title AS titulo FROM works w WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = w.doc_id AND s.class = 'Conclusion') ORDER BY titulo, doc_id LIMIT 20")
def without_section(c: Corpus, kind: str = "Conclusion", limit: int = 20) -> DataFrame:
    have = c.sections.where(F.col("class") == kind).select("doc_id")
    return c.works.join(have, "doc_id", "left_anti").orderBy("title", "doc_id").limit(limit).select(F.col("title").alias("titulo"))


def cited(c: Corpus, longer: int, exclude=()) -> DataFrame:
    found = c.refs.where(F.length("ref_title") > longer)
    return found.where(~contains_any(F.col("ref_title"), list(exclude), lower=False)) if exclude else found


@query("S10", "SELECT ref_title AS ref_titulo, count(*) AS n_citacoes FROM refs WHERE length(ref_title) > 10 GROUP BY ref_title ORDER BY n_citacoes DESC, ref_titulo LIMIT 20")
def most_cited(c: Corpus, longer: int = 10, limit: int = 20, exclude=()) -> DataFrame:
    return top(cited(c, longer, exclude).groupBy(F.col("ref_title").alias("ref_titulo")).agg(n(alias="n_citacoes")), "n_citacoes", limit, "ref_titulo")


@query("R10", "SELECT ref_title AS ref_titulo, count(*) AS n_citacoes FROM refs WHERE length(ref_title) > 10 AND NOT contains(ref_title, '#1 ') AND NOT contains(ref_title, '#2 ') GROUP BY ref_title ORDER BY n_citacoes DESC, ref_titulo LIMIT 10")
def most_cited_others(c: Corpus) -> DataFrame:
    return most_cited(c, 10, 10, ("#1 ", "#2 "))


@query("S11", "SELECT k.keyword, i.content AS limitacao FROM keywords k JOIN items i USING (doc_id) WHERE i.kind = 'limitation' AND contains(lower(k.keyword), 'c') ORDER BY k.keyword, limitacao, doc_id, j LIMIT 20")
def limitations_of_keyword(c: Corpus, term: str = TERMS["keyword"], limit: int = 20) -> DataFrame:
    k = c.keywords.where(F.contains(F.lower("keyword"), F.lit(term)))
    return k.join(item_texts(c, "limitation"), "doc_id").orderBy("keyword", "content", "doc_id", "j").limit(limit).select("keyword", F.col("content").alias("limitacao"))


@query("S12", "SELECT content AS future_work FROM items WHERE kind = 'future' ORDER BY content, doc_id LIMIT 30")
def future_work(c: Corpus, limit: int = 30) -> DataFrame:
    return item_texts(c, "future").orderBy("content", "doc_id").limit(limit).select(F.col("content").alias("future_work"))


def _top_keywords(limit: int):
    def plan(c: Corpus, longer: int = 4, limit: int = limit) -> DataFrame:
        return top(c.keywords.where(F.length("keyword") > longer).groupBy("keyword").agg(n(alias="freq")), "freq", limit, "keyword")

    return plan


for _id, _n in (("S13", 25), ("R11", 15)):
    CATALOG[_id] = (_top_keywords(_n), f"SELECT keyword, count(*) AS freq FROM keywords WHERE length(keyword) > 4 GROUP BY keyword ORDER BY freq DESC, keyword LIMIT {_n}")


@query("S15", "SELECT title AS titulo, year AS ano, content AS claim FROM works JOIN items USING (doc_id) WHERE kind = 'claim' AND year >= '1998' AND length(title) > 15 AND (contains(lower(content), 'and') OR contains(lower(content), 'und')) ORDER BY ano DESC, titulo, claim, doc_id, j LIMIT 15")
def recent_claims(c: Corpus, since: str = "1998", terms=("and", "und"), limit: int = 15) -> DataFrame:
    found = titled(c, 15).where(F.col("year") >= since).join(item_texts(c, "claim").where(contains_any(F.col("content"), list(terms))), "doc_id")
    return found.orderBy(F.desc("year"), "title", "content", "doc_id", "j").limit(limit).select(F.col("title").alias("titulo"), F.col("year").alias("ano"), F.col("content").alias("claim"))


def topics(c: Corpus, a=tuple(TERMS["topic_a"]), b=tuple(TERMS["topic_b"])) -> DataFrame:
    flag = lambda terms: F.sum(F.when(contains_any(F.col("subject"), list(terms)), 1).otherwise(0))
    return c.works.where(F.length("year") == 4).join(c.subjects, "doc_id").groupBy(F.col("year").alias("ano")).agg(flag(a).alias("ml"), flag(b).alias("fem"))


_TOPICS_SQL = "SELECT year AS ano, CAST(sum(CASE WHEN contains(lower(subject), 'src1') OR contains(lower(subject), 'priority') THEN 1 ELSE 0 END) AS BIGINT) AS ml, CAST(sum(CASE WHEN contains(lower(subject), 'high') THEN 1 ELSE 0 END) AS BIGINT) AS fem FROM works JOIN subjects USING (doc_id) WHERE length(year) = 4 GROUP BY year"
CATALOG["S16"] = (topics, _TOPICS_SQL)
CATALOG["R08"] = (lambda c: topics(c).where("ml > 0 or fem > 0"), f"SELECT * FROM ({_TOPICS_SQL}) WHERE ml > 0 OR fem > 0")


def _per_area(kind: str, column: str, limit: int, longer: int = 0, strip: bool = False):
    def plan(c: Corpus, limit: int = limit) -> DataFrame:
        s = c.subjects.where(F.startswith("subject", F.lit(SUBJECT_PREFIX)) & (F.length("subject") > longer))
        found = top(s.join(item_texts(c, kind), "doc_id").groupBy(F.col("subject").alias("area")).agg(n(alias=column)), column, limit, "area")
        return found.withColumn("area", F.replace("area", F.lit(SUBJECT_PREFIX), F.lit(""))) if strip else found

    return plan


def _per_area_sql(kind: str, column: str, limit: int, longer: int = 0, strip: bool = False) -> str:
    sql = f"SELECT subject AS area, count(*) AS {column} FROM subjects JOIN items USING (doc_id) WHERE kind = '{kind}' AND starts_with(subject, '{SUBJECT_PREFIX}') AND length(subject) > {longer} GROUP BY subject ORDER BY {column} DESC, area LIMIT {limit}"
    return f"SELECT replace(area, '{SUBJECT_PREFIX}', '') AS area, {column} FROM ({sql})" if strip else sql


for _id, _a in {"S17": ("limitation", "n_limitacoes", 15), "R09": ("limitation", "n_limitacoes", 8, 0, True), "A02": ("future", "n_futuros", 20, 10), "R14": ("future", "n_futuros", 8, 0, True)}.items():
    CATALOG[_id] = (_per_area(*_a), _per_area_sql(*_a))


@query("S18", "SELECT title AS titulo, year AS ano, count(*) AS n_fw FROM works JOIN items USING (doc_id) WHERE type = 'DoctoralThesis' AND kind = 'future' AND length(title) > 20 GROUP BY title, year ORDER BY n_fw DESC, titulo, ano LIMIT 15")
def future_by_title(c: Corpus, limit: int = 15) -> DataFrame:
    found = titled(c).where("type = 'DoctoralThesis'").join(item_texts(c, "future"), "doc_id")
    return top(found.groupBy(F.col("title").alias("titulo"), F.col("year").alias("ano")).agg(n(alias="n_fw")), "n_fw", limit, "titulo", "ano")


@query("S19", "SELECT class AS tipo_secao, count(*) AS n_claims FROM disc_sections JOIN items USING (doc_id, sec) WHERE kind = 'claim' GROUP BY class")
def claims_per_class(c: Corpus) -> DataFrame:
    return c.disc_sections.join(item_texts(c, "claim"), ["doc_id", "sec"]).groupBy(F.col("class").alias("tipo_secao")).agg(n(alias="n_claims"))


@query("S20", "SELECT title AS titulo FROM works WHERE lang = 'en' ORDER BY titulo, doc_id LIMIT 20")
def by_language(c: Corpus, lang: str = "en", limit: int = 20) -> DataFrame:
    return c.works.where(F.col("lang") == lang).orderBy("title", "doc_id").limit(limit).select(F.col("title").alias("titulo"))


@query("A01", "SELECT year AS ano, count(DISTINCT doc_id) AS docs_com_ml FROM works JOIN items USING (doc_id) WHERE kind = 'claim' AND length(year) = 4 AND (contains(lower(content), 'the') OR contains(lower(content), 'und') OR contains(lower(content), 'que')) GROUP BY year")
def works_with_terms(c: Corpus, terms=("the", "und", "que")) -> DataFrame:
    found = item_texts(c, "claim").where(contains_any(F.col("content"), list(terms))).select("doc_id")
    return c.works.where(F.length("year") == 4).join(found, "doc_id", "left_semi").groupBy(F.col("year").alias("ano")).agg(F.count_distinct("doc_id").alias("docs_com_ml"))


_DENSITY = "SELECT type AS tipo, count(DISTINCT w.doc_id) AS n_docs, count(i.content) AS total_claims FROM works w LEFT JOIN (SELECT * FROM items WHERE kind = 'claim') i USING (doc_id) GROUP BY type"


def density(c: Corpus) -> DataFrame:
    """Works and claims by type; works without claims count as works."""
    per = item_texts(c, "claim").groupBy("doc_id").agg(n(alias="k"))
    return c.works.join(per, "doc_id", "left").groupBy(F.col("type").alias("tipo")).agg(F.count_distinct("doc_id").alias("n_docs"), F.coalesce(F.sum("k"), F.lit(0)).alias("total_claims"))


CATALOG["A03"] = CATALOG["R07"] = (density, _DENSITY)


@query("A04", "SELECT content AS limitacao FROM subjects JOIN items USING (doc_id) WHERE kind = 'limitation' AND contains(lower(subject), 'urgent') AND length(content) > 30 ORDER BY content, doc_id, j LIMIT 20")
def limitations_of_area(c: Corpus, term: str = TERMS["area"], limit: int = 20) -> DataFrame:
    s = c.subjects.where(F.contains(F.lower("subject"), F.lit(term))).select("doc_id")
    return s.join(item_texts(c, "limitation").where(F.length("content") > 30), "doc_id").orderBy("content", "doc_id", "j").limit(limit).select(F.col("content").alias("limitacao"))


@query("A05", "SELECT title AS titulo, count(DISTINCT (doc_id, i)) AS n_secoes, count(*) AS n_paragrafos FROM works JOIN paragraphs USING (doc_id) WHERE length(title) > 20 GROUP BY title ORDER BY n_paragrafos DESC, titulo LIMIT 15")
def structure(c: Corpus, limit: int = 15) -> DataFrame:
    """Sections with paragraphs, and paragraphs, by title; counted per section first, so nothing distinct is shuffled."""
    per = c.paragraphs.groupBy("doc_id", "i").agg(n(alias="k")).groupBy("doc_id").agg(n(alias="s"), F.sum("k").alias("p"))
    found = titled(c).join(per, "doc_id").groupBy(F.col("title").alias("titulo")).agg(F.sum("s").alias("n_secoes"), F.sum("p").alias("n_paragrafos"))
    return top(found, "n_paragrafos", limit, "titulo")


@query("A06", f"SELECT subject AS area, ref_title AS ref_titulo, count(*) AS n FROM subjects JOIN refs USING (doc_id) WHERE starts_with(subject, '{SUBJECT_PREFIX}') AND length(ref_title) > 8 AND NOT contains(ref_title, '#1 ') AND NOT contains(ref_title, '#2 ') GROUP BY ALL ORDER BY area, n DESC, ref_titulo LIMIT 30")
def canonical_refs(c: Corpus, limit: int = 30) -> DataFrame:
    s = c.subjects.where(F.startswith("subject", F.lit(SUBJECT_PREFIX)))
    found = s.join(cited(c, 8, ("#1 ", "#2 ")), "doc_id").groupBy(F.col("subject").alias("area"), F.col("ref_title").alias("ref_titulo")).agg(n(alias="n"))
    return found.orderBy("area", F.desc("n"), "ref_titulo").limit(limit)


@query("A07", "SELECT title AS titulo, content AS contribuicao FROM works JOIN items USING (doc_id) WHERE kind = 'contribution' AND length(title) > 20 AND length(content) > 60 AND NOT (contains(lower(content), 'este trabalho') OR contains(lower(content), 'neste trabalho') OR contains(lower(content), 'this work') OR contains(lower(content), 'this thesis')) ORDER BY md5('42|' || doc_id || '|' || j), doc_id, j LIMIT 15")
def sample_contributions(c: Corpus, seed: int = 42, limit: int = 15) -> DataFrame:
    """A random sample of specific contributions; the seed makes it repeatable."""
    found = titled(c).join(item_texts(c, "contribution").where(F.length("content") > 60), "doc_id")
    found = found.where(~contains_any(F.col("content"), ["este trabalho", "neste trabalho", "this work", "this thesis"]))
    return shuffled(found, seed, "doc_id", "j").limit(limit).select(F.col("title").alias("titulo"), F.col("content").alias("contribuicao"))


@query("A08", "SELECT year AS ano, count(DISTINCT doc_id) AS total FROM works JOIN (SELECT doc_id FROM subjects WHERE contains(lower(subject), 'high') UNION ALL SELECT doc_id FROM keywords WHERE contains(lower(keyword), 'high') OR contains(lower(keyword), 'cl')) USING (doc_id) WHERE length(year) = 4 GROUP BY year")
def theme_per_year(c: Corpus, terms=("high", "cl"), subject_terms=("high",)) -> DataFrame:
    hit = c.subjects.where(contains_any(F.col("subject"), list(subject_terms))).select("doc_id").unionByName(c.keywords.where(contains_any(F.col("keyword"), list(terms))).select("doc_id"))
    return c.works.where(F.length("year") == 4).join(hit.distinct(), "doc_id").groupBy(F.col("year").alias("ano")).agg(n())


@query("A09", f"SELECT year AS ano, class AS tipo, count(*) AS total FROM works JOIN sections USING (doc_id) WHERE year >= '1997' AND length(year) = 4 AND class IN ({DISCOURSE_SQL}) GROUP BY year, class")
def classes_per_year(c: Corpus, since: str = "1997") -> DataFrame:
    w = c.works.where((F.length("year") == 4) & (F.col("year") >= since))
    return w.join(c.sections.where(F.col("class").isin(*RHETORICAL)), "doc_id").groupBy(F.col("year").alias("ano"), F.col("class").alias("tipo")).agg(n())


def marked_claims(c: Corpus, markers=tuple(TERMS["markers"]), longer: int = 50, limit: int = 20) -> DataFrame:
    found = titled(c).join(item_texts(c, "claim").where((F.length("content") > longer) & contains_any(F.col("content"), list(markers), lower=False)), "doc_id")
    return found.orderBy("title", "content", "doc_id", "j").limit(limit).select(F.col("title").alias("titulo"), F.col("content").alias("claim"))


_MARKED = "SELECT title AS titulo, content AS claim FROM works JOIN items USING (doc_id) WHERE kind = 'claim' AND length(title) > 20 AND length(content) > 50 AND (contains(content, 'the ') OR contains(content, 'und ') OR contains(content, 'que ')) ORDER BY titulo, claim, doc_id, j LIMIT {}"
CATALOG["A10"] = (marked_claims, _MARKED.format(20))
CATALOG["R12"] = (lambda c: marked_claims(c, limit=5).select(F.substring("titulo", 1, 70).alias("titulo"), F.substring("claim", 1, 150).alias("claim")), f"SELECT substr(titulo, 1, 70) AS titulo, substr(claim, 1, 150) AS claim FROM ({_MARKED.format(5)})")


@query("R06", "SELECT count(*) FILTER (WHERE kind = 'claim') AS claims, count(*) FILTER (WHERE kind = 'contribution') AS contribs, count(*) FILTER (WHERE kind = 'limitation') AS limits, count(*) FILTER (WHERE kind = 'future') AS fw FROM items")
def item_totals(c: Corpus) -> DataFrame:
    count = lambda kind, name: F.count(F.when(F.col("kind") == kind, 1)).alias(name)
    return c.items.agg(count("claim", "claims"), count("contribution", "contribs"), count("limitation", "limits"), count("future", "fw"))


CATALOG["R01"], CATALOG["R03"] = CATALOG["S01"], CATALOG["S03"]


@query("X03", "SELECT handle, title AS titulo FROM works WHERE handle = '11422/7'")
def title_of(c: Corpus, handle: str = "11422/7") -> DataFrame:
    return c.works.where(F.col("handle") == handle).select("handle", F.col("title").alias("titulo"))


@query("X05", "SELECT DISTINCT title AS titulo, year AS ano, content AS claim, doc_id, j FROM works JOIN subjects USING (doc_id) JOIN items USING (doc_id) WHERE type = 'MastersThesis' AND year >= '1996' AND contains(lower(subject), 'high') AND kind = 'claim' AND contains(lower(content), 'and') AND length(title) > 20 ORDER BY ano DESC, titulo, claim, doc_id, j LIMIT 10")
def masters_claims(c: Corpus, since: str = "1996", subject: str | None = "high", term: str = "and", limit: int = 10) -> DataFrame:
    w = titled(c).where((F.col("type") == "MastersThesis") & (F.col("year") >= since))
    if subject is not None:
        w = w.join(c.subjects.where(F.contains(F.lower("subject"), F.lit(subject))), "doc_id", "left_semi")
    found = w.join(item_texts(c, "claim").where(F.contains(F.lower("content"), F.lit(term))), "doc_id")
    return found.orderBy(F.desc("year"), "title", "content", "doc_id", "j").limit(limit).select(F.col("title").alias("titulo"), F.col("year").alias("ano"), F.col("content").alias("claim"), "doc_id", "j")


CATALOG["X07"] = (lambda c: masters_claims(c, subject=None), "SELECT title AS titulo, year AS ano, content AS claim, doc_id, j FROM works JOIN items USING (doc_id) WHERE type = 'MastersThesis' AND year >= '1996' AND kind = 'claim' AND contains(lower(content), 'and') AND length(title) > 20 ORDER BY ano DESC, titulo, claim, doc_id, j LIMIT 10")


@query("X06", "SELECT year AS ano, count(*) AS pares FROM works w JOIN items a ON a.doc_id = w.doc_id AND a.kind = 'claim' JOIN items b ON b.doc_id = w.doc_id AND b.kind = 'limitation' WHERE TRY_CAST(year AS INTEGER) >= 1996 GROUP BY year")
def claim_limitation_pairs(c: Corpus, since: int = 1996) -> DataFrame:
    """Pairs of a work's claims and limitations, by year: counts are multiplied per work, so no pair is made."""
    per = c.items.groupBy("doc_id").agg(F.count(F.when(F.col("kind") == "claim", 1)).alias("a"), F.count(F.when(F.col("kind") == "limitation", 1)).alias("b")).where("a > 0 and b > 0")
    return c.works.where(F.col("year").try_cast("int") >= since).join(per, "doc_id").groupBy(F.col("year").alias("ano")).agg(F.sum(F.col("a") * F.col("b")).alias("pares"))


def run(name: str, corpus: Corpus, **arguments) -> DataFrame:
    return CATALOG[name][0](corpus, **arguments)


def names() -> list[str]:
    return sorted(CATALOG)


def oracle(name: str) -> str | None:
    sql = CATALOG[name][1]
    return None if sql is None else sql_prefix() + sql


def export(corpus: Corpus, path: str, queries: list[str] | None = None) -> None:
    """The results of all queries, or of some, as JSON lines in a folder for each; see sinks.export_results."""
    sinks.export_results({k: run(k, corpus) for k in (names() if queries is None else queries)}, path)
