"""TEI, services, harvesting and reports on literal input."""

import io
import os
import urllib.error

import pyarrow as pa
from corpusloom.plans import operator_queries, report
from corpusloom.sources import services, tei, workers
from corpusloom.sources.adapters import Corpus
from pyspark.sql import functions as F

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  title</title></titleStmt>
<sourceDesc><biblStruct><analytic><author><persName><forename>Ana</forename><surname>Souza</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short abstract.</p></abstract></profileDesc></teiHeader><text><body>
<div><head n="1">Intro <hi>duction</hi></head><p>{p30}</p><p>{p29}</p><div><head>Nested</head><p>{long}</p></div></div><div></div></body>
<back><listBibl><biblStruct><analytic><title level="a">Paper</title></analytic><monogr><title level="m">Book</title><date type="published" when="2004-05"/></monogr></biblStruct>
<biblStruct><monogr><title level="m">Only book</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    text = TEI.format(p30="x" * 30, p29="y" * 29, long="z" * 500)
    rows = spark.createDataFrame([("a", text), ("b", "<broken"), ("c", "<TEI xmlns='http://www.tei-c.org/ns/1.0'/>"), ("d", None)], "name string, content string")
    got = {r["name"]: r for r in tei.parse_table(rows).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "parse_error", "c": "no_body_element", "d": "parse_error"}
    a = got["a"]
    assert (a["title"], a["authors"], a["abstract"]) == ("A title", ["Ana Souza"], ["Short abstract."])
    assert [(s["head"], s["n"], len(s["paragraphs"])) for s in a["sections"]] == [("Intro duction", "1", 1), ("Nested", "", 1)]
    assert [(r["title"], r["year"]) for r in a["refs"]] == [("Paper", "2004"), ("Only book", "")]
    assert tei.paragraphs(tei.parse_table(rows)).count() == 2


def test_fetch_tries_again():
    calls, waits = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        return io.BytesIO(b"ok")

    assert services.fetch("u", opener=opener, sleep=waits.append) == b"ok" and waits == [3.0, 6.0]

    def gone(url, timeout):
        raise urllib.error.HTTPError(url, 404, "gone", None, None)

    assert services.fetch("u", opener=gone, sleep=waits.append) is None and len(waits) == 2


def test_workers_hold_few_rows_at_once(spark):
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": ["x" * 100] * 990 + ["y" * workers.SLICE_BYTES] * 5 + [None] * 5})
    got = list(workers.slices([batch, batch.slice(0, 0)]))
    assert [k for b in got for k in b["k"]] == list(range(1000)) and [t for b in got for t in b["t"]] == batch["t"].to_pylist()
    assert max(len(b["k"]) for b in got) <= workers.SLICE_ROWS and all(len(b["t"]) == 1 or sum(len(t or "") for t in b["t"]) <= workers.SLICE_BYTES for b in got)
    xml = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body><div><head>One</head><p>" + "word " * 2000 + "</p></div></body></text></TEI>"
    df = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("name"), F.lit(xml).alias("content"))
    for plan in (tei.parse_table(df), tei.outline(df), services.with_client(df, "name", "content", lambda: str)):
        assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    assert tei.parse_table(df).where("status = 'ok' and size(sections) = 1").count() == 1000


def test_sections_come_from_sliced_workers(spark, small):
    plan = operator_queries.run("UD4", Corpus(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_a_worker_grows_little_over_its_documents(spark, monkeypatch):
    """A task of 100 MB of documents in one partition: what its worker holds, from document to document."""
    real = tei.parse

    def parse(content):
        with open("/proc/self/statm") as f:
            return real(content) | {"body_chars": int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")}

    monkeypatch.setattr(tei, "parse", parse)
    xml = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body><div><head>One</head><p>" + "word " * 2000 + "</p></div></body></text></TEI>"
    df = spark.range(0, 10000, 1, 1).select(F.col("id").cast("string").alias("name"), F.lit(xml).alias("content"))
    told = tei.parse_table(df).where("size(sections) = 1").agg(F.count("*").alias("n"), (F.max("body_chars") - F.min("body_chars")).alias("grown")).first()
    assert told["n"] == 10000 and told["grown"] < 64 << 20, told


def test_large_ids_beside_null_ones_stay_exact(spark):
    rows = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "id long, t string").coalesce(1)
    assert sorted(services.with_client(rows, "id", "t", lambda: str.upper).select("id", "answer").collect(), key=str) == [(2**53 + 1, "A"), (None, "B")]


def test_clients_report_errors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "boom")], "id long, text string")

    def make():
        def client(text):
            if text == "boom":
                raise ValueError("no")
            return text.upper()

        return client

    got = {r["id"]: (r["answer"], r["error"]) for r in services.with_client(rows, "id", "text", make, 2).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no")}


PAGE = b"""<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record><header><identifier>oai:x:1</identifier><datestamp>2020</datestamp><setSpec>s1</setSpec></header><metadata><d xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:type>Tese</dc:type><dc:type>b</dc:type></d></metadata></record>
<record><header status="deleted"><identifier>oai:x:2</identifier></header></record><resumptionToken>next</resumptionToken></ListRecords></OAI-PMH>"""


def test_oai_pages():
    rows, token = services.records_of(PAGE)
    assert token == "next" and rows[0][4] == {"title": ["T"], "type": ["Tese", "b"]} and rows[1][3] is True


def test_oai_source(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = PAGE.replace(b"next", b"") if "resumptionToken" in self.path else PAGE
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(services.OaiSource)
    load = lambda **o: spark.read.format("oai").options(url=f"http://127.0.0.1:{server.server_port}/", **o).load()
    assert load().count() == 4
    assert load(sets="s1,s2").count() == 8
    assert load(limit="3").count() == 3
    server.shutdown()


def test_report_and_steps(spark, small):
    text = report.build(Corpus(spark, small), [("Types", "R02"), ("Items", "R06")])
    assert "| tipo | total |" in text and "## Items" in text
    assert report.table(spark.createDataFrame([], "a int")) == report.NO_DATA
    assert report.table(spark.createDataFrame([("x|y" + "z" * 200,)], "a string")).splitlines()[2] == "| x\\|y" + "z" * 97 + " |"

    def fail():
        raise ValueError("no")

    steps = [("a", lambda: 1), ("b", fail), ("c", lambda: 2)]
    status = lambda **k: [r["status"] for r in report.run_steps(steps, **k)]
    assert status() == ["ok", "error", "skipped"]
    assert status(stop=False) == ["ok", "error", "ok"]
    assert status(from_step="c") == ["skipped", "skipped", "ok"]
    assert status(only="a", dry_run=True) == ["planned", "skipped", "skipped"]
    assert [report.duration(x) for x in (5, 65, 3725)] == ["5s", "1m 5s", "1h 2m 5s"]
