"""Rule tables, gates, structure, analysis and comparison on literal rows."""

import json

import pytest
from corpusloom.functions import rules
from corpusloom.operators import comparison, discourse, gates, structure
from corpusloom.sources import readers, tei
from pyspark.sql import functions as F


def classes(spark, heads):
    df = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, h string")
    return [r["c"] for r in df.select("k", rules.section_class(F.col("h")).alias("c")).orderBy("k").collect()]


def test_section_classes(spark):
    heads = {"1 Introdução": "deo:Introduction", "VII - CONCLUSÕES": "deo:Conclusion", " Considerações Finais ": "deo:Conclusion", "Final remarks": "deo:Conclusion", "3. Related Work": "deo:RelatedWork", "Materiais e Métodos": "doco:Section", "Metodologia proposta": "deo:Methods", "Capítulo 5 Resultados": "deo:Results", "ANÁLISE": "deo:Discussion", "Referencial teórico": "deo:Background", "REFERÊNCIAS": "doco:ListOfReferences", "Apêndice A": "doco:Appendix", "Sugestões": "deo:FutureWork", "Resumo": "doco:Abstract", "": "doco:Section", "Figura 3": "doco:Section"}
    assert dict(zip(heads, classes(spark, heads))) == heads | {"Materiais e Métodos": "deo:Methods"}
    assert classes(spark, [None]) == ["doco:Section"]


def test_target_sections_fall_back_by_document(spark):
    long = "x" * 100
    rows = [
        ("a", 0, "Conclusões", long, "doco:Section"), ("a", 1, "Outro", "os resultados mostram " + long, "doco:Section"), ("a", 2, "Results", "short", "deo:Results"),
        ("b", 0, "", "It was shown that " + long, "doco:Section"), ("b", 1, "Outro", long, "deo:Results"),
        ("c", 0, "Outro", "tiny", "deo:Results"), ("c", 1, "Outro", long, "deo:Methods"), ("d", 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, i int, head string, text string, class string")
    got = sorted((r["doc_id"], r["i"], r["head"], r["source"]) for r in rules.target_sections(df).collect())
    assert got == [("a", 0, "Conclusões", "tei"), ("b", 0, "[sem título]", "tei_content_search"), ("c", 0, "Outro", "ttl_fallback")]


def test_keywords_and_abstracts(spark):
    df = spark.createDataFrame([(["Results", " Turbina ", "turbina", "aço", "Dados", "Fadiga", "Solda TIG", "Trinca", "Ensaio", "Ruptura"], ["Agradeço a todos " + "x" * 300, "yy", "Neste trabalho z"])], "w array<string>, p array<string>")
    r = df.select(rules.keywords(F.col("w")).alias("k"), rules.abstract_of(F.col("p")).alias("a"), rules.abstract_of(F.array().cast("array<string>")).alias("none")).first()
    assert r["k"] == ["Turbina", "Fadiga", "Solda TIG", "Trinca", "Ensaio"] and r["a"] == "Neste trabalho z" and r["none"] == ""


def test_pdf_gate(spark):
    rows = [("1_2.pdf", b"%PDF-" + b"a" * 20000), ("1_3.pdf", b"<html" + b"a" * 20000), ("1_4.pdf", b"%PDF-abc"), ("1_5.pdf", b"%PDF-" + b"\0" * 20000), ("1_6_7.pdf", None), ("1_8.pdf", b"")]
    df = spark.createDataFrame([(n, len(c or b""), None if c is None else bytearray(c)) for n, c in rows], "name string, length long, content binary")
    got = {r["handle"]: (r["reject"], r["reasons"]) for r in gates.gate_pdf(df).collect()}
    assert got["1/2"] == (False, []) and got["1/3"] == (True, ["invalid_magic: b'<html'"]) and got["1/4"] == (True, ["too_small: 0.0KB"])
    assert got["1/5"] == (True, ["likely_scan: density=0.0%"]) and got["1/6_7"] == (True, ["read_error"]) and got["1/8"] == (True, ["invalid_magic: b''"])
    judged = gates.gate_pdf(df)
    assert [tuple(r) for r in gates.reason_counts(judged).collect()] == [("invalid_magic", 2), ("likely_scan", 1), ("read_error", 1), ("too_small", 1)]
    totals = gates.gate_totals(judged).first()
    assert (totals["total"], totals["ok"], totals["rejected_percent"]) == (6, 1, 83)
    assert gates.accepted(judged).count() == 1 and gates.rejected(judged).count() == 5


def document(title="A plain title", persons=("Ana Souza",), heads=("Introdução", "Results"), text="word " * 200, refs=()):
    divs = "".join(f"<div><head>{h}</head><p>{text}</p></div>" if h else f"<div><p>{text}</p></div>" for h in heads)
    people = "".join(f"<author><persName><surname>{p}</surname></persName></author>" for p in persons)
    listed = "".join(f'<biblStruct><analytic><title level="a">{r}</title></analytic></biblStruct>' for r in refs)
    return f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>{title}</title></titleStmt><sourceDesc><biblStruct><analytic>{people}</analytic></biblStruct></sourceDesc></fileDesc></teiHeader><text><body>{divs}</body><back><listBibl>{listed}</listBibl></back></text></TEI>'


def test_gates_round_halves_to_even(spark):
    pdf = b"%PDF-" + b"x" * 100
    df = spark.createDataFrame([("1.pdf", 7424, pdf), ("2.pdf", 7936, pdf), ("3.pdf", 90_500_000, pdf), ("4.pdf", 91_500_000, pdf)], "name string, length long, content binary")
    got = {r["handle"]: r["reasons"] for r in gates.gate_pdf(df).collect()}
    assert got == {"1": ["too_small: 7.2KB"], "2": ["too_small: 7.8KB"], "3": ["too_large: 90MB"], "4": ["too_large: 92MB"]}
    body = ("a" * 123 + "#" * 77) * 5  # 38.5 %
    outline = spark.createDataFrame([("1.xml", "ok", "", [], body, ["One", "Two"], [])], tei.OUTLINE)
    assert gates.gate_tei(outline).first()["reasons"] == ["high_garbage: 38%"]


def test_tei_gate(spark):
    docs = {
        "1_1": document(), "1_2": "<broken", "1_3": '<TEI xmlns="http://www.tei-c.org/ns/1.0"/>', "1_4": document(title="Capítulo 3 2005"),
        "1_5": document(text="word"), "1_6": document(text="#% w@ " * 150), "1_7": document(heads=("Introdução", "", "12")),
        "1_8": document(persons=("CAPÍTULO 3", "Anexo 12", "Ana")), "1_9": document(refs=("#$%&!"[:3] + "@@", "Fine title of a paper", "(((((")), "1_10": None,
    }
    df = spark.createDataFrame([(k + ".tei.xml", v.replace("&", "") if v else v) for k, v in docs.items()], "name string, content string")
    got = {r["handle"]: (r["reject"], r["reasons"]) for r in gates.gate_tei(tei.outline(df)).collect()}
    assert got == {
        "1/1": (False, []), "1/2": (True, ["parse_error"]), "1/3": (True, ["no_body"]), "1/4": (True, ["title_is_toc"]),
        "1/5": (True, ["body_too_short: 28ch"]), "1/6": (True, got["1/6"][1]),
        "1/7": (True, ["few_real_sections: 1"]), "1/8": (False, ["grobid_authors_unreliable: 2/3"]), "1/9": (False, ["grobid_refs_unreliable: 2/3"]), "1/10": (True, ["parse_error"]),
    }
    assert got["1/6"][0] and got["1/6"][1][0].startswith("high_garbage: ")


def test_structure_and_repairs(spark):
    parsed = tei.parse_table(spark.createDataFrame([("1_2.tei.xml", document(refs=("p. 123", "Neural networks for turbines"))), ("9_9.tei.xml", document())], "name string, content string"))
    manifest = spark.createDataFrame([{"handle": "1/2", "title": "From the manifest", "creators": [], "types": ["Tese"], "date": "2017-06-06T1", "description": "d" * 30, "language": "por"}, {"handle": "1/3", "title": " Another title that is fine "}, {"handle": "1/4", "title": "Resumo"}], readers.MANIFEST)
    works = structure.structure(parsed, manifest).collect()
    assert len(works) == 1
    w = works[0]
    assert (w["handle"], w["title"], w["authors"], w["type"], tuple(w["date"]), w["abstract"]) == ("1/2", "A plain title", ["Ana Souza"], "DoctoralThesis", ("2017-06-06", "date"), "d" * 30)
    assert [s["class"] for s in w["sections"]] == ["deo:Introduction", "deo:Results"] and [r["title"] for r in w["refs"]] == ["Neural networks for turbines"]
    assert [r["handle"] for r in structure.matched(parsed, manifest)[1].collect()] == ["9/9"]
    current = spark.createDataFrame([("1/2", "A plain title"), ("1/4", "Sumário")], "handle string, title string")
    repairs = structure.repair_titles(manifest, current)
    assert {r["handle"]: r["decision"] for r in repairs.collect()} == {"1/2": "ja_ok", "1/3": "corrigido", "1/4": "ruins_sem_manifest"}
    assert [tuple(r) for r in structure.corrections(repairs).collect()] == [("1/3", "(vazio)", "Another title that is fine")]


def test_analysis(spark):
    text = "Os resultados mostram um ganho de 23% sobre a linha de base. A proposta contribui com um algoritmo novo. " + "Turbinas eólicas modernas. " * 5
    docs = spark.createDataFrame([("a", "", "Manifest title"), ("b", "Dedico este trabalho", "Real title"), ("c", "T", None), ("d", "T", None)], "doc_id string, title string, manifest_title string")
    sections = spark.createDataFrame([("a", 0, "Conclusões", text, None), ("a", 1, "Resultados", text, None), ("b", 0, "Results", text, None), ("c", 0, "Outro", "x" * 200, None), ("d", 0, "Results", text, None)], "doc_id string, i int, head string, text string, class string")

    def make():
        def client(prompt):
            if "Real title" in prompt:
                return 'Sure: {"claims": ["cut off after an item"'
            if 'Thesis: "T"' in prompt:
                raise OSError("down")
            return discourse.rule_answer(prompt)

        return client

    got = {r["doc_id"]: r for r in discourse.analyze(docs, sections, make, 2).collect()}
    assert {k: (r["status"], len(r["sections"])) for k, r in got.items()} == {"a": ("ok", 2), "b": ("ok", 1), "c": ("no_target_sections", 0), "d": ("llm_failed", 0)}
    assert got["a"]["doc_title"] == "Manifest title" and got["b"]["doc_title"] == "Real title"
    first = got["a"]["sections"][0]
    assert first["rhetorical_type"] == "conclusion" and "23%" in first["claims"][0] and "turbinas" in first["keywords_inferred"]
    assert got["b"]["sections"][0]["claims"] == ["cut off after an item"]
    items, found, words = discourse.enrich(discourse.analyze(docs, sections, make))
    assert {r["kind"] for r in items.collect()} >= {"claim", "contribution"}
    assert {r["class"] for r in found.collect()} == {"deo:Conclusion", "deo:Results", "doco:Section"} and words.count() > 0
    assert discourse.rule_answer("x") == discourse.rule_answer("x")


def test_diagnosis(spark):
    docs = spark.createDataFrame([(k,) for k in range(5)], "doc_id int")
    sections = spark.createDataFrame([(0, "Resultados"), (1, ""), (2, "Figura")], "doc_id int, head string")
    graph = spark.createDataFrame([(1, "deo:Results", 2, 1), (2, "deo:Results", 2, 0), (3, "doco:Section", 1, 1), (4, "deo:Results", 0, 0)], "doc_id int, class string, n_paragraphs int, n_with_content int")
    got = {r["doc_id"]: (r["tei_ok"], r["graph_ok"], r["causes"]) for r in discourse.diagnose_sections(docs, sections, graph).collect()}
    assert got == {0: (True, False, []), 1: (False, True, []), 2: (False, False, [discourse.NO_TARGET_HEADS, discourse.NO_GRAPH_TEXT]), 3: (False, False, [discourse.NO_HEADS, discourse.NO_GRAPH_SECTIONS]), 4: (False, False, [discourse.NO_HEADS, discourse.NO_GRAPH_LINKS])}


LONG = "A concrete finding about turbines, with a number: 42"


@pytest.mark.parametrize(
    "raw,want",
    [
        (json.dumps({"claims": [LONG, "short"], "contributions": [], "keywords_inferred": ["Turbina", "data", "abcd"], "rhetorical_type": "results"}), (True, 2, 1, 1, True, 1)),
        ("```json\n" + json.dumps({"claims": [LONG], "rhetorical_type": "mixed"}) + "\n```", (True, 1, 1, 0, False, 0)),
        ('before {"claims": ["' + LONG + '"]', (True, 1, 1, 0, False, 0)),  # a brace is missing
        ('{"claims": ["' + LONG + '"', (False, 0, 0, 0, False, 0)),  # a bracket and a brace: not closed together here
        ("no object", (False, 0, 0, 0, False, 0)),
        ("", (False, 0, 0, 0, False, 0)),
        (None, (False, 0, 0, 0, False, 0)),
    ],
)
def test_answer_quality(spark, raw, want):
    q = comparison.quality(spark.createDataFrame([(raw,)], "answer string")).first()["q"]
    assert (q["valid_json"], q["total"], q["specific"], q["generic"], q["rhet_ok"], q["keywords_ok"]) == want


def test_models_are_compared(spark):
    good = json.dumps({"claims": [LONG] * 3, "contributions": [LONG], "limitations": [LONG], "future_work": [LONG], "keywords_inferred": ["Turbina", "Fadiga", "Solda"], "rhetorical_type": "results"})
    rows = [("a", good, 8.0, 100, ""), ("a", good, 6.0, 0, ""), ("b", good, 4.0, 50, ""), ("b", None, 150.0, 0, "timeout"), ("c", good, 9.0, 10, "")]
    out = comparison.compare(spark.createDataFrame(rows, "model string, answer string, time double, tokens int, error string"))
    got = [(r["model"], r["score"], r["avg_time"], r["avg_tokens"], r["errors"], r["timeouts"], r["json_fail"]) for r in out.collect()]
    assert got == [("a", 13, 7.0, 100.0, 0, 0, 0), ("c", 13, 9.0, 10.0, 0, 0, 0), ("b", 8, 77.0, 50.0, 1, 1, 1)]
    assert comparison.recommend(out).first()["model"] == "a"
