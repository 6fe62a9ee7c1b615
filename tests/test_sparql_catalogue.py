"""Every query of the catalogue, said in SPARQL over the triples, gives the rows of the catalogue's own plan."""

import pytest
from corpusloom.plans import catalog, graph, sparql
from corpusloom.sources.adapters import Corpus

WORK, TITLED = "?w a fabio:Work . ", "?w dcterms:title ?name . FILTER(STRLEN(?name) > 20) "
YEAR = "?w dcterms:date ?when . BIND(SUBSTR(STR(?when), 1, 4) AS ?y) "
FULL = YEAR + "FILTER(STRLEN(?y) = 4) "
EDGE = {"claim": "discourse:hasClaim", "contribution": "discourse:hasContribution", "limitation": "discourse:hasLimitation", "future": "discourse:hasFutureWork"}


def said(kind):
    return f"?w {EDGE[kind]} ?item . ?item c4o:hasContent ?told . "


def has(name, *terms, lower=True):
    x = f"LCASE(?{name})" if lower else f"?{name}"
    return "FILTER(" + " || ".join(f'CONTAINS({x}, "{t}")' for t in terms) + ") "


DEO = 'FILTER(STRSTARTS(STR(?c), "deo:") && ?c != deo:Section) '
CNPQ = 'FILTER(STRSTARTS(?s, "CNPQ::")) '


def per_title(kind, limit):
    return f"SELECT ?name (COUNT(?item) AS ?n) WHERE {{ {WORK}{TITLED}?w {EDGE[kind]} ?item }} GROUP BY ?name ORDER BY DESC(?n) ?name LIMIT {limit}"


def per_area(kind, limit, more=""):
    return f"SELECT ?s (COUNT(?item) AS ?n) WHERE {{ {WORK}?w dcterms:subject ?s . {CNPQ}{more}?w {EDGE[kind]} ?item }} GROUP BY ?s ORDER BY DESC(?n) ?s LIMIT {limit}"


def subjects(limit):
    return f"SELECT ?s (COUNT(?w) AS ?n) WHERE {{ ?w dcterms:subject ?s }} GROUP BY ?s ORDER BY DESC(?n) ?s LIMIT {limit}"


def references(limit, longer, more=""):
    return f"SELECT ?cited (COUNT(?r) AS ?n) WHERE {{ ?r a bibo:Article . ?r dcterms:title ?cited . FILTER(STRLEN(?cited) > {longer}) {more}}} GROUP BY ?cited ORDER BY DESC(?n) ?cited LIMIT {limit}"


OTHERS = 'FILTER(!CONTAINS(?cited, "#1 ") && !CONTAINS(?cited, "#2 ")) '
TOPICS = f'SELECT ?y (SUM(IF(CONTAINS(LCASE(?s), "src1") || CONTAINS(LCASE(?s), "priority"), 1, 0)) AS ?one) (SUM(IF(CONTAINS(LCASE(?s), "high"), 1, 0)) AS ?two) WHERE {{ {WORK}{FULL}?w dcterms:subject ?s }} GROUP BY ?y'
DENSITY = f'SELECT (SUBSTR(STR(?t), 7) AS ?kind) ?works ?n WHERE {{ {{ SELECT ?t (COUNT(DISTINCT ?w) AS ?works) (COUNT(?item) AS ?n) WHERE {{ ?w a ?t . FILTER(?t IN (fabio:DoctoralThesis, fabio:MastersThesis)) OPTIONAL {{ ?w discourse:hasClaim ?item }} }} GROUP BY ?t }} }}'
MASTERS = f'?w a fabio:MastersThesis . {TITLED}{YEAR}FILTER(?y >= "1996") ' + said("claim") + has("told", "and")

TEXTS = {
    "S02": "SELECT (SUBSTR(STR(?t), 7) AS ?kind) ?n WHERE { { SELECT ?t (COUNT(?w) AS ?n) WHERE { ?w a ?t . FILTER(?t IN (fabio:DoctoralThesis, fabio:MastersThesis, fabio:Work)) } GROUP BY ?t } }",
    "R02": "SELECT (SUBSTR(STR(?t), 7) AS ?kind) ?n WHERE { { SELECT ?t (COUNT(?w) AS ?n) WHERE { ?w a ?t . FILTER(?t IN (fabio:DoctoralThesis, fabio:MastersThesis)) } GROUP BY ?t } }",
    "S03": f"SELECT (SUBSTR(STR(?c), 5) AS ?kind) ?n WHERE {{ {{ SELECT ?c (COUNT(?x) AS ?n) WHERE {{ ?x a ?c . {DEO}}} GROUP BY ?c }} }}",
    "S04": subjects(20),
    "R05": subjects(10),
    "S05": "SELECT ?name ?text WHERE { ?w po:contains ?x . ?x a deo:Conclusion . ?x po:contains ?p . ?p c4o:hasContent ?text . ?w dcterms:title ?name . " + has("text", "licen") + "} ORDER BY ?name ?text LIMIT 10",
    "S06": f'SELECT ?y (COUNT(?w) AS ?n) WHERE {{ {WORK}{YEAR}FILTER(?y >= "1970" && ?y <= "2030") }} GROUP BY ?y',
    "R04": f"SELECT ?y (COUNT(?w) AS ?n) WHERE {{ {WORK}{FULL}}} GROUP BY ?y",
    "S07": per_title("claim", 15),
    "S14": per_title("limitation", 15),
    "R13": f"SELECT (SUBSTR(?name, 1, 80) AS ?cut) ?n WHERE {{ {{ {per_title('limitation', 5)} }} }}",
    "S08": "SELECT ?name ?told WHERE { " + WORK + "?w dcterms:title ?name . " + said("claim") + has("told", "and") + "} ORDER BY ?name ?told LIMIT 20",
    "S09": "SELECT ?name WHERE { " + WORK + "?w dcterms:title ?name . FILTER NOT EXISTS { ?w po:contains ?x . ?x a deo:Conclusion } } ORDER BY ?name LIMIT 20",
    "S10": references(20, 10),
    "R10": references(10, 10, OTHERS),
    "S11": "SELECT ?k ?told WHERE { ?w discourse:inferredKeyword ?k . " + has("k", "c") + said("limitation") + "} ORDER BY ?k ?told LIMIT 20",
    "S12": "SELECT ?told WHERE { " + said("future") + "} ORDER BY ?told LIMIT 30",
    "S13": "SELECT ?k (COUNT(?w) AS ?n) WHERE { ?w discourse:inferredKeyword ?k . FILTER(STRLEN(?k) > 4) } GROUP BY ?k ORDER BY DESC(?n) ?k LIMIT 25",
    "R11": "SELECT ?k (COUNT(?w) AS ?n) WHERE { ?w discourse:inferredKeyword ?k . FILTER(STRLEN(?k) > 4) } GROUP BY ?k ORDER BY DESC(?n) ?k LIMIT 15",
    "S15": "SELECT ?name ?y ?told WHERE { " + WORK + "?w dcterms:title ?name . FILTER(STRLEN(?name) > 15) " + YEAR + 'FILTER(?y >= "1998") ' + said("claim") + has("told", "and", "und") + "} ORDER BY DESC(?y) ?name ?told LIMIT 15",
    "S16": TOPICS,
    "R08": TOPICS + ' HAVING (SUM(IF(CONTAINS(LCASE(?s), "src1") || CONTAINS(LCASE(?s), "priority"), 1, 0)) > 0 || SUM(IF(CONTAINS(LCASE(?s), "high"), 1, 0)) > 0)',
    "S17": per_area("limitation", 15),
    "R09": f"SELECT (SUBSTR(?s, 7) AS ?area) ?n WHERE {{ {{ {per_area('limitation', 8)} }} }}",
    "A02": per_area("future", 20, "FILTER(STRLEN(?s) > 10) "),
    "R14": f"SELECT (SUBSTR(?s, 7) AS ?area) ?n WHERE {{ {{ {per_area('future', 8)} }} }}",
    "S18": f"SELECT ?name ?y (COUNT(?item) AS ?n) WHERE {{ ?w a fabio:DoctoralThesis . {TITLED}OPTIONAL {{ {YEAR}}} ?w discourse:hasFutureWork ?item }} GROUP BY ?name ?y ORDER BY DESC(?n) ?name ?y LIMIT 15",
    "S19": "SELECT (SUBSTR(STR(?c), 5) AS ?kind) ?n WHERE { { SELECT ?c (COUNT(?item) AS ?n) WHERE { ?w discourse:hasAnalyzedSection ?x . ?x a ?c . ?x discourse:hasClaim ?item } GROUP BY ?c } }",
    "S20": 'SELECT ?name WHERE { ?w dcterms:language "en" . ?w dcterms:title ?name } ORDER BY ?name LIMIT 20',
    "A01": "SELECT ?y (COUNT(DISTINCT ?w) AS ?n) WHERE { " + WORK + FULL + said("claim") + has("told", "the", "und", "que") + "} GROUP BY ?y",
    "A03": DENSITY,
    "R07": DENSITY,
    "A04": "SELECT ?told WHERE { ?w dcterms:subject ?s . " + has("s", "urgent") + said("limitation") + "FILTER(STRLEN(?told) > 30) } ORDER BY ?told LIMIT 20",
    "A05": f"SELECT ?name (COUNT(DISTINCT ?x) AS ?parts) (COUNT(DISTINCT ?p) AS ?n) WHERE {{ {WORK}{TITLED}?w po:contains ?x . ?x po:contains ?p . ?p a doco:Paragraph }} GROUP BY ?name ORDER BY DESC(?n) ?name LIMIT 15",
    "A06": f"SELECT ?s ?cited (COUNT(?r) AS ?n) WHERE {{ {WORK}?w bibo:handle ?h . ?w dcterms:subject ?s . {CNPQ}BIND(IRI(CONCAT(STR(?w), \"_references\")) AS ?list) ?list po:contains ?r . ?r dcterms:title ?cited . FILTER(STRLEN(?cited) > 8) {OTHERS}}} GROUP BY ?s ?cited ORDER BY ?s DESC(?n) ?cited LIMIT 30",
    "A08": f"SELECT ?y (COUNT(DISTINCT ?w) AS ?n) WHERE {{ {WORK}{FULL}{{ ?w dcterms:subject ?s . {has('s', 'high')}}} UNION {{ ?w discourse:inferredKeyword ?k . {has('k', 'high', 'cl')}}} }} GROUP BY ?y",
    "A09": f'SELECT ?y (SUBSTR(STR(?c), 5) AS ?kind) ?n WHERE {{ {{ SELECT ?y ?c (COUNT(?x) AS ?n) WHERE {{ {WORK}{FULL}FILTER(?y >= "1997") ?w po:contains ?x . ?x a ?c . {DEO}}} GROUP BY ?y ?c }} }}',
    "A10": f"SELECT ?name ?told WHERE {{ {WORK}{TITLED}" + said("claim") + "FILTER(STRLEN(?told) > 50) " + has("told", "the ", "und ", "que ", lower=False) + "} ORDER BY ?name ?told LIMIT 20",
    "R12": "SELECT (SUBSTR(?name, 1, 70) AS ?a) (SUBSTR(?told, 1, 150) AS ?b) WHERE { { SELECT ?name ?told WHERE { " + WORK + TITLED + said("claim") + "FILTER(STRLEN(?told) > 50) " + has("told", "the ", "und ", "que ", lower=False) + "} ORDER BY ?name ?told LIMIT 5 } }",
    "X03": 'SELECT ?h ?name WHERE { ?w bibo:handle "11422/7" . ?w bibo:handle ?h . ?w dcterms:title ?name } LIMIT 1',
    "X05": "SELECT ?name ?y ?told WHERE { { SELECT DISTINCT ?w ?name ?y ?item ?told WHERE { " + MASTERS + "?w dcterms:subject ?s . " + has("s", "high") + "} } } ORDER BY DESC(?y) ?name ?told LIMIT 10",
    "X07": "SELECT ?name ?y ?told WHERE { " + MASTERS + "} ORDER BY DESC(?y) ?name ?told LIMIT 10",
    "X06": f"SELECT ?y (COUNT(?a) AS ?n) WHERE {{ {WORK}{YEAR}FILTER(xsd:integer(?y) >= 1996) ?w discourse:hasClaim ?a . ?w discourse:hasLimitation ?b }} GROUP BY ?y",
}
COUNTS = {
    "claims": "SELECT (COUNT(?item) AS ?n) WHERE { ?item c4o:hasContent ?t . ?w discourse:hasClaim ?item . FILTER(!CONTAINS(STR(?w), \"_disc_\")) }",
    "contribs": "SELECT (COUNT(?item) AS ?n) WHERE { ?w discourse:hasContribution ?item . FILTER(!CONTAINS(STR(?w), \"_disc_\")) }",
    "limits": "SELECT (COUNT(?item) AS ?n) WHERE { ?w discourse:hasLimitation ?item . FILTER(!CONTAINS(STR(?w), \"_disc_\")) }",
    "fw": "SELECT (COUNT(?item) AS ?n) WHERE { ?w discourse:hasFutureWork ?item }",
}


@pytest.fixture(scope="module")
def corpus(spark, small):
    """Keywords of users that are no documents have no node in the graph, so the corpus has those of documents alone."""
    c = Corpus(spark, small)
    docs = c.raw("documents").select("doc_id")
    c.keywords = c.keywords.join(docs, "doc_id", "left_semi")
    return c


@pytest.fixture(scope="module")
def triples(corpus):
    return graph.as_set(graph.work_triples(corpus), graph.discourse_triples(corpus, 0)).cache()


def values(df, names):
    return sorted(tuple(str(v) for v in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_same_rows_as_the_plan(corpus, triples, name):
    want = catalog.run(name, corpus)
    got = sparql.select(TEXTS[name], triples)
    assert values(got, got.columns) == values(want, want.columns[: len(got.columns)])
    assert got.head(1) or not want.head(1)


def test_totals(corpus, triples):
    want = catalog.run("R06", corpus).first()
    assert {k: sparql.select(q, triples).first()["n"] for k, q in COUNTS.items()} == want.asDict()
    counts = [sparql.select(q, triples).first()["n"] for q in ("SELECT (COUNT(DISTINCT ?w) AS ?n) WHERE { ?w a fabio:Work }", "SELECT (COUNT(?x) AS ?n) WHERE { ?w a fabio:Work . ?w po:contains ?x }", "SELECT (COUNT(?p) AS ?n) WHERE { ?w a fabio:Work . ?w po:contains ?x . ?x po:contains ?p }")]
    assert counts == list(catalog.run("S01", corpus).first())


def test_every_query_is_said():
    assert set(catalog.names()) - set(TEXTS) <= {"S01", "R01", "R03", "R06", "A07"}  # repeats, sums above, a random sample
