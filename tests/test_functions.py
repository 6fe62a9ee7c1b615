"""Rule tables, readers, record shaping, audits and triples on literal rows."""

import json

import pytest
from corpusloom.functions import rules
from corpusloom.functions import text as fn
from corpusloom.operators import audits, records
from corpusloom.plans import graph
from corpusloom.sources import readers
from pyspark.sql import functions as F


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("title,bad", [("", True), ("abc", True), ("Lista de figuras", True), ("LISTA DE SÍMBOLOS", True), ("Ao professor Silva", True), ("Sumário", True), ("CAPÍTULO IV", True), ("1234567890 ab", True), ("x" * 251, True), ("Redes neurais em engenharia", False), ("Um estudo sobre conclusões", False)])
def test_noise_titles(spark, title, bad):
    assert one(spark, fn.is_noise_title(F.col("t")), t=title) == bad


@pytest.mark.parametrize("name,bad", [("Maria da Silva", False), ("CAPÍTULO 3 algo", True), ("Ana 2005", True), ("—", True), ("Ana Maria Costa Souza", True), ("José Álvaro", False)])
def test_heading_authors(spark, name, bad):
    assert one(spark, fn.is_heading_author(F.col("t")), t=name) == bad


@pytest.mark.parametrize("title,bad", [("p. 123", True), ("https://a.b/c/dddddddd", True), ("In: Proceedings of something", True), ("São Paulo editora nacional", True), ("12 34 56 78 90 ab cd ef", True), ("Neural networks for control", False), ("Análise", True)])
def test_bad_references(spark, title, bad):
    assert one(spark, records.is_bad_reference(F.col("t")), t=title) == bad


@pytest.mark.parametrize("date,want", [("2017-06-06T18:51:42Z", ("2017-06-06", "date")), ("2021-03-15", ("2021-03-15", "date")), ("2005", ("2005", "gYear")), ("20x5", ("", "")), ("", ("", "")), ("2021-99-99", ("2021-99-99", "date"))])
def test_date_literals(spark, date, want):
    assert tuple(one(spark, fn.date_literal(F.col("d")), d=date)) == want


def test_handles_and_stems(spark):
    assert one(spark, fn.stem(F.col("h")), h="11422/12/3") == "11422_12_3"
    assert one(spark, fn.handle_of(F.col("h")), h="11422_12_3") == "11422/12_3"


@pytest.mark.parametrize("types,want", [(["Tese"], "DoctoralThesis"), (["Dissertação"], "MastersThesis"), (["Artigo", "TESE de doutorado"], "DoctoralThesis"), ([], "MastersThesis")])
def test_work_types(spark, types, want):
    assert one(spark, fn.work_type(F.col("t"), fn.WORK_TYPES, "MastersThesis"), t=types) == want


@pytest.mark.parametrize("raw", ['{"a": ["x"]}', '```json\n{"a": ["x"]}\n```', 'Sure: {"a": ["x"', '{"a": ["x"]'])
def test_json_is_repaired(spark, raw):
    assert json.loads(one(spark, fn.repair_json(F.col("r")), r=raw)) == {"a": ["x"]}


def test_keywords_keep_their_first_casing(spark):
    words = ["Redes", "redes", " Dados ", "abc", "Métodos", "Turbina", "Aço inox", "Solda", "Fadiga"]
    got = one(spark, fn.first_casing(F.col("w"), ["dados"], 4, 5), w=words)
    assert got == ["Redes", "Métodos", "Turbina", "Aço inox", "Solda"]
    assert one(spark, fn.first_casing(F.col("w"), ["dados"], 4, 5), w=[]) == []


def test_ratios(spark):
    assert one(spark, fn.garbage_ratio(F.col("t")), t="") == 1.0
    assert one(spark, fn.garbage_ratio(F.col("t")), t="ação 12 ##") == pytest.approx(2 / 10)
    assert one(spark, fn.alpha_ratio(F.col("t")), t="ação12") == pytest.approx(4 / 6)


def test_abstract_choices(spark):
    long, mid = "a" * 100, "b" * 20
    choose = records.choose_abstract(F.col("p"), F.col("m"))
    assert one(spark, choose, p=long, m=mid) == long
    assert one(spark, choose, p="short", m=mid) == mid
    assert one(spark, choose, p="short", m="tiny") == "short"
    assert one(spark, choose, p="", m="tiny") == "tiny"
    pick = records.abstract_paragraph(F.col("p"), ["dedico"], ["resumo"])
    assert one(spark, pick, p=["Dedico isto" + "x" * 200, "yy", "zzzz", "aaaa"]) == "zzzz"
    assert one(spark, pick, p=["y" * 100, "Resumo: z"]) == "Resumo: z"


def test_manifest_reader(spark, tmp_path):
    path = tmp_path / "manifest.jsonl"
    path.write_text("\n".join([json.dumps({"handle": "1/2", "title": " old ", "types": ["Tese"]}), "", "{broken", json.dumps({"title": "no handle"}), json.dumps({"handle": "1/2", "title": " new "}), json.dumps({"handle": "1/3", "title": ""})]))
    got = {r["handle"]: r["title"] for r in readers.load_manifest(spark, f"file://{path}").collect()}
    assert got == {"1/2": " new ", "1/3": ""}
    assert [tuple(r) for r in readers.titles(readers.load_manifest(spark, f"file://{path}")).collect()] == [("1/2", "new")]
    assert readers.find_manifest(spark, None, [f"file://{tmp_path}/none", f"file://{path}"]) == f"file://{path}"
    with pytest.raises(readers.ManifestNotFound):
        readers.find_manifest(spark, None, [f"file://{tmp_path}/none"])
    found, where = readers.load_manifest_index(spark, [f"file://{tmp_path}/none", f"file://{path}"])
    assert where and found.count() == 2
    assert readers.load_manifest_index(spark, [])[1] == ""


def test_discourse_reader_leaves_broken_files_out(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"handle": "1/2", "status": "ok", "sections": [{"claims": ["c"]}]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    got = readers.load_discourse(spark, f"file://{tmp_path}").collect()
    assert [(r["handle"], r["sections"][0]["claims"]) for r in got] == [("1/2", ["c"])]
    assert [r["name"] for r in readers.files(spark, f"file://{tmp_path}", "*.json").select("name").orderBy("name").collect()] == ["a.json", "b.json"]


def test_turtle_blocks(spark):
    lines = ["@prefix base: <x> .", "base:a a doco:Section ;", "  dcterms:title 'A' .", "base:b a doco:Section .", "  more"]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file string, line int, value string")
    got = {r["subject"]: r["block"] for r in readers.turtle_blocks(df).collect()}
    assert got == {"base:a": "\n".join(lines[1:3]), "base:b": "\n".join(lines[3:])}


def test_links_by_rank_then_place(spark):
    html = '<a href="/x?sequence=1">1</a><a href="/bitstream/a.pdf">2</a><a href="/bitstream/b.pdf">3</a>'
    assert one(spark, readers.first_link(F.col("h"), [r"\.pdf$", "sequence="]), h=html) == "/bitstream/a.pdf"
    assert one(spark, readers.first_link(F.col("h"), ["zip"]), h=html) is None
    assert one(spark, readers.absolute("https://s.org/path", F.col("h")), h="/x") == "https://s.org/x"


def test_missing_values_keep_repeats(spark):
    got = one(spark, records.missing_values(F.col("w"), F.col("h")), w=["a", "b", "", "b", "c"], h=["c"])
    assert got == ["a", "b", "b"]


def test_audit_and_patch(spark):
    fields = "doc_id long, creators array<string>, subjects array<string>, date string, title string, language string, type string, m_creators array<string>, m_subjects array<string>, m_date string, m_title string, m_language string, m_type string, n_triples long, n_rhetorical long"
    row = (1, ["X"], ["s"], "2001", "", "", "MastersThesis", ["A", "B"], ["s", "t"], "2005", "T", "por", "DoctoralThesis", 60, 1)
    out = audits.patch(audits.audit(spark.createDataFrame([row], fields))).first()
    assert out["problems"] == ["wrong_type", "missing_title", "missing_creators", "missing_date", "missing_subjects"]
    assert (out["creators"], out["subjects"], out["date"], out["title"], out["type"], out["added"]) == (["A", "B"], ["s", "t"], "2005", "T", "DoctoralThesis", 5)
    loose = audits.validate(spark.createDataFrame([row], fields)).first()
    assert "wrong_type" not in loose["problems"] and loose["noted"] == ["wrong_type", "missing_language"]


def test_triples_are_a_set(spark):
    rows = [("a", "p", "1", "lit", ""), ("a", "p", "1", "lit", ""), ("a", "q", "b", "iri", "")]
    g = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_dt string")
    assert graph.as_set(g, g).count() == 2
    assert graph.remove(graph.as_set(g), g.where("p = 'q'")).count() == 1
    new = spark.createDataFrame([("a", "2")], "s string, o string")
    assert {r["o"] for r in graph.replace_values(g, "p", new).where("p = 'p'").collect()} == {"2"}
    assert graph.turtle(graph.as_set(g)).first()["block"] == 'a\n    p "1" ;\n    q b .'


def test_alternatives_find_what_each_pattern_finds(spark):
    for patterns in (rules.CONTENT_PHRASES, rules.TARGET_HEADS, fn.NOISE_TITLE, fn.HEADING_AUTHOR, [r"\bab|cd", r"\bk?x", r"\b(?:one|two)\b", r"\bkelvin", r"\bin[|]de"]):
        texts = ["", "xcd", "X", "x kelvin", "\u212aELVIN", "akelvin", "in|de", "two", "WE CONCLUDE", "awe conclude", "\u0130t was shown that", "\u0131n this work we presented", "\u017fugestões para trabalhos futuros", "éin this work it presented", "Os resultados\u00a0mostram", "the results indicate", "conclui-se  que", "Conclusão", "xconclusão", "VII - CONCLUSÕES", "Capítulo 5 Resultados", "final", "trabalho futuro incluirá", "Recomendações", "o UFRJ parte dos requisitos", "....." ]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        plain = F.col("t").rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))
        assert df.where(~F.col("t").isNull() & (fn.any_rule(F.col("t"), patterns, "(?iuU)") != plain)).collect() == []
    shared = fn.alternatives(rules.CONTENT_PHRASES)  # one look at the border for all that open at one
    assert shared.count("(?=") == 1 and all(f"|{p}" not in shared for p in rules.CONTENT_PHRASES)
    assert fn.alternatives([r"\bab|cd", r"\bk?x"]) == r"(?:\bab|cd)|(?:\bk?x)"


def test_json_is_repaired_without_patterns_where_it_is_whole(spark):
    raw = [None, "", "no braces", '{"a": [1, 2', '  {"a": {"é": ["x"', '```json\n{"a": 1}\n```', '```json {"a": [1 ```\n', 'text {"a": 1}', '{"a": "```"}', '{"a": 1}]]', "[1, {", "``` ```"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    body = F.regexp_replace(F.regexp_replace(F.trim("x"), r"^```(?:json)?\s*|\s*```$", ""), r"^[^{]*", "")
    missing = lambda a, b: F.greatest(F.regexp_count(body, F.lit(a)) - F.regexp_count(body, F.lit(b)), F.lit(0))
    plain = F.concat(body, F.repeat(F.lit("]"), missing(r"\[", r"\]")), F.repeat(F.lit("}"), missing(r"\{", r"\}")))
    assert df.where(~fn.repair_json(F.col("x")).eqNullSafe(plain)).collect() == []
    assert "regexp_count" not in str(fn.repair_json(F.col("x")))
