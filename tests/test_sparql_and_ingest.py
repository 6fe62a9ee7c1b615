"""The SPARQL subset against the catalogue's plans, and incremental ingest."""

import json

import pytest
from corpusloom.plans import catalog, graph, sparql
from corpusloom.sources.adapters import Corpus
from corpusloom.streaming import ingest


@pytest.fixture(scope="module")
def corpus(spark, small):
    return Corpus(spark, small)


@pytest.fixture(scope="module")
def triples(corpus):
    return graph.as_set(graph.work_triples(corpus), graph.discourse_triples(corpus, 0)).cache()


def same(a, b):
    assert sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_documents_of_a_span_of_years(corpus, triples):
    q = """SELECT ?y (COUNT(?work) AS ?n) WHERE { ?work dcterms:date ?when .
           BIND(SUBSTR(STR(?when), 1, 4) AS ?y) ?work a fabio:Work . FILTER(!(?y < "1970") && !(?y > "2030")) } GROUP BY ?y"""
    same(sparql.select(q, triples), catalog.run("S06", corpus))


def test_sums_of_conditions(corpus, triples):
    q = """SELECT ?y (SUM(IF(CONTAINS(LCASE(?topic), "priority") || CONTAINS(LCASE(?topic), "src1"), 1, 0)) AS ?first)
           (SUM(IF(CONTAINS(LCASE(?topic), "high"), 1, 0)) AS ?second)
           WHERE { ?w dcterms:subject ?topic . ?w a fabio:Work . ?w dcterms:date ?when .
           BIND(SUBSTR(STR(?when), 1, 4) AS ?y) FILTER(STRLEN(?y) = 4) } GROUP BY ?y"""
    same(sparql.select(q, triples), catalog.run("S16", corpus))


def test_counts_per_group_with_a_limit(corpus, triples):
    q = """SELECT ?branch (COUNT(?gap) AS ?gaps) WHERE { ?w discourse:hasLimitation ?gap . ?w dcterms:subject ?branch .
           ?w a fabio:Work . FILTER(STRSTARTS(?branch, "CNPQ::")) } GROUP BY ?branch ORDER BY DESC(COUNT(?gap)) ?branch LIMIT 15"""
    same(sparql.select(q, triples), catalog.run("S17", corpus))


def test_optional_parts_count_as_zero(corpus, triples):
    q = """SELECT ?kind (COUNT(DISTINCT ?w) AS ?works) (COUNT(?said) AS ?n) WHERE { ?w a ?kind .
           OPTIONAL { ?w discourse:hasClaim ?said } FILTER(?kind IN (fabio:MastersThesis, fabio:DoctoralThesis)) } GROUP BY ?kind"""
    got = {(r["kind"].split(":")[1], r["works"], r["n"]) for r in sparql.select(q, triples).collect()}
    assert got == {tuple(r) for r in catalog.run("A03", corpus).collect()}


def test_union_and_not_exists(corpus, triples):
    q = """SELECT ?y (COUNT(DISTINCT ?w) AS ?n) WHERE {
           { ?w discourse:inferredKeyword ?word FILTER(CONTAINS(LCASE(?word), "cl") || CONTAINS(LCASE(?word), "high")) }
           UNION { ?w dcterms:subject ?word FILTER(CONTAINS(LCASE(?word), "high")) }
           ?w dcterms:date ?when . ?w a fabio:Work . BIND(SUBSTR(STR(?when), 1, 4) AS ?y) FILTER(STRLEN(?y) = 4) } GROUP BY ?y"""
    same(sparql.select(q, triples), catalog.run("A08", corpus))
    q = """SELECT ?name WHERE { ?w dcterms:title ?name . ?w a fabio:Work .
           FILTER NOT EXISTS { ?part a deo:Conclusion . ?w po:contains ?part } }"""
    assert sparql.select(q, triples).count() == catalog.without_section(corpus, limit=10**6).count()


def few(spark):
    rows = [("a", "p", "1"), ("a", "q", "x"), ("b", "p", "2"), ("b", "r", "y"), ("c", "p", "3"), ("c", "q", "x"), ("c", "r", "x")]
    return spark.createDataFrame([(*r, "lit", "") for r in rows], "s string, p string, o string, o_kind string, o_dt string")


def listed(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_unbound_variables_are_compatible(spark):
    t = few(spark)
    q = "SELECT ?s ?v WHERE { ?s x:p ?n . OPTIONAL { ?s x:q ?v } OPTIONAL { ?s x:r ?v } }"
    named = t.replace({"p": "x:p", "q": "x:q", "r": "x:r"}, subset=["p"])
    assert listed(sparql.select(q, named)) == [("a", "x"), ("b", "y"), ("c", "x")]
    q = "SELECT ?s WHERE { ?s x:p ?n . OPTIONAL { ?s x:q ?v } FILTER NOT EXISTS { ?s x:r ?v } }"
    assert listed(sparql.select(q, named)) == [("a",)]
    q = 'SELECT ?s WHERE { ?s x:p ?n . FILTER NOT EXISTS { ?other x:q "zzz" } }'
    assert len(listed(sparql.select(q, named))) == 3
    assert listed(sparql.select(q.replace("zzz", "x"), named)) == []


def test_arithmetic_having_and_aggregates_in_expressions(spark):
    named = few(spark).replace({"p": "x:p", "q": "x:q", "r": "x:r"}, subset=["p"])
    q = "SELECT ?s WHERE { ?s x:p ?n . FILTER(?n * 2 + 1 > 4) }"
    assert listed(sparql.select(q, named)) == [("b",), ("c",)]
    q = "SELECT ?s (COUNT(?o) * 10 AS ?n) WHERE { ?s ?p ?o } GROUP BY ?s HAVING (COUNT(?o) > 2) ORDER BY DESC(COUNT(?o))"
    assert listed(sparql.select(q, named)) == [("c", "30")]


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x }", "ASK { ?x a ?y }", "SELECT ?x WHERE { ?x a ?y } WINDOW", "SELECT (COUNT(?x) AS ?x) WHERE { ?x a ?y }", "SELECT ?x WHERE { ?x a ?y FILTER(FOO(?x)) }"])
def test_other_text_is_refused(triples, text):
    with pytest.raises(sparql.SparqlError):
        sparql.select(text, triples)


def test_first_record_wins_across_runs(spark, tmp_path):
    src, table, check = (f"file://{tmp_path}/{x}" for x in ("in", "table", "check"))
    (tmp_path / "in").mkdir()

    def put(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    row = lambda h, t, at, kind="Tese", date="2005": {"handle": h, "title": t, "collected_at": at, "types": [kind], "date": date}
    put("a.json", row("1", "first", "1"), row("1", "second", "2"), row("2", "x", "1", "Artigo"), row("3", "old", "1", date="1990"))
    ingest.ingest(spark, src, table, check)
    put("b.json", row("1", "third", "3"), row("4", "new", "3", date=""))
    ingest.ingest(spark, src, table, check)
    ingest.ingest(spark, src, table, check)
    got = {r["handle"]: r["title"] for r in spark.read.parquet(table).collect()}
    assert got == {"1": "first", "4": "new"}


def test_what_a_rerun_still_has_to_do(spark):
    rows = spark.createDataFrame([(f"1/{k}",) for k in range(6)], "handle string")
    log = spark.createDataFrame([("1/0", "ok"), ("1/1", "http_500"), ("1/2", "ok"), ("1/2", "ok")], "handle string, status string")
    assert [r["handle"] for r in ingest.pending(rows, log, ["ok"]).orderBy("handle").collect()] == ["1/1", "1/3", "1/4", "1/5"]
    assert [r["handle"] for r in ingest.pending(rows, log, ["ok"], 2).collect()] == ["1/1", "1/3"]
