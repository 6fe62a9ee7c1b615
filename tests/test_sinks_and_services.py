"""Sinks, versioned tables, Turtle, service clients and streaming harvests."""

import http.server
import json
import threading

import pytest
from corpusloom.plans import graph, operator_queries, report
from corpusloom.sources import services, sinks, storage, turtle
from corpusloom.sources.adapters import Corpus
from corpusloom.streaming import harvest
from pyspark.sql import functions as F


def test_versioned_tables(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        storage.read(spark, at)
    storage.replace(spark.range(3).toDF("a"), at)
    storage.replace(storage.read(spark, at).where("a > 0"), at)  # reads the table that it replaces
    assert sorted(r["a"] for r in storage.read(spark, at).collect()) == [1, 2]
    (tmp_path / "t" / "v7").mkdir()  # a writer that died
    assert storage.versions(spark, at)[-1] != 7 and storage.read(spark, at).count() == 2


def triples(spark, rows):
    return spark.createDataFrame(rows, sinks.TRIPLES)


def test_triple_store(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    g = triples(spark, [("a", "p", "1", "lit", ""), ("a", "p", "1", "lit", ""), ("b", "q", "a", "iri", "")])
    assert sinks.create_dataset(spark, at) and not sinks.create_dataset(spark, at)
    assert sinks.load_triples(g, at) and not sinks.load_triples(g, at)
    assert sinks.load_triples(triples(spark, [("c", "p", "2", "lit", "")]), at, reload=True)
    assert storage.read(spark, at).count() == 3
    sinks.replace_values(at, "p", spark.createDataFrame([("a", "9")], "s string, o string"))
    assert {(r["s"], r["o"]) for r in storage.read(spark, at).where("p = 'p'").collect()} == {("a", "9"), ("c", "2")}


def test_small_graph_makes_nothing_of_sections_and_references(spark, small):
    g = operator_queries.small_graph(Corpus(spark, small))
    tables = {f.rsplit("/", 1)[-1] for f in g.inputFiles()}
    assert tables == {"documents.parquet", "orders.parquet", "customer.parquet"}
    every = graph.as_set(graph.work_triples(Corpus(spark, small))).where("p in ('dcterms:title', 'dcterms:creator', 'dcterms:subject') and s not like '%!_sec!_%' escape '!' and s not like '%!_ref!_%' escape '!'")
    assert g.count() > 0 and sorted(g.collect()) == sorted(every.collect())


def test_turtle_round_trip(spark, tmp_path):
    g = triples(spark, [("base:a", "a", "base:C", "iri", ""), ("base:a", "x:t", 'say "hi"\\\nnext', "lit", ""), ("base:b", "x:d", "2005", "lit", "xsd:gYear")])
    sinks.write_turtle(g, f"file://{tmp_path}/ttl", {"base": "http://b/", "x": "http://x/", "xsd": "http://w/"})
    back = turtle.read(spark, f"file://{tmp_path}/ttl", "part-*")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in g.collect()}
    text = "@prefix b: <http://b/> .\nb:s b:p b:o, \"x\"@pt , 12 ; a <http://b/C> ;\n.\n# note\n<http://b/t> b:p '''no''' ."
    with pytest.raises(turtle.TurtleError):
        turtle.parse(text)
    assert turtle.parse(text[: text.index("# note")]) == [("b:s", "b:p", "b:o", "iri", ""), ("b:s", "b:p", "x", "lit", "@pt"), ("b:s", "b:p", "12", "lit", "xsd:integer"), ("b:s", "a", "b:C", "iri", "")]
    bad = turtle.parse_table(spark.createDataFrame([("f", "b:s b:p"), ("g", None)], "file string, value string")).collect()
    assert len(bad) == 1 and bad[0]["error"]


def test_logs_entities_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}", k % 2 == 0) for k in range(10)], "k long, v string, reject boolean")
    log, one, good, bad = (f"file://{tmp_path}/{x}" for x in ("log", "one", "good", "bad"))
    sinks.append_lines(rows, log)
    sinks.append_lines(rows, log)
    assert spark.read.json(log).count() == 20
    sinks.overwrite_lines(rows, log)
    assert spark.read.json(log).count() == 10
    sinks.write_entities(rows, one, "k", 4)
    assert [r["v"] for r in sinks.read_entity(spark, one, "k long, v string", "k", 7, 4).collect()] == ["v7"]
    sinks.split_rejects(rows, good, bad)
    assert spark.read.parquet(good).count() == 5 and spark.read.parquet(bad).where("not reject").count() == 0
    sinks.export_results({"q1": rows, "q2": rows.limit(1)}, f"{log}2")
    assert {r["query"]: r["count"] for r in spark.read.json(f"{log}2").groupBy("query").count().collect()} == {"q1": 10, "q2": 1}
    sinks.write_run_log(spark, report.run_steps([("a", lambda: 1)]), f"{log}3", {"limit": 3})
    r = spark.read.json(f"{log}3").first()
    assert json.loads(r["args"]) == {"limit": 3} and r["steps"][0]["status"] == "ok"
    assert sinks.read_state(spark, f"{log}4") == (None, 0, 0)
    sinks.write_state(spark, f"{log}4", "tok", 100, 60)
    sinks.write_state(spark, f"{log}4", None, 200, 90)
    assert sinks.read_state(spark, f"{log}4") == (None, 200, 90)


def client():
    class Client:  # workers can't import test modules
        def head(self, url):
            return 10**9 if "huge" in url else None

        def get(self, url, most):
            if "down" in url:
                raise OSError("down")
            if "grows" in url:
                raise sinks.TooLarge("grew")
            return {"gone": None, "page": ("text/html", b"<html>"), "fake": ("application/pdf", b"<html>")}.get(url, ("application/PDF; x", b"%PDF-1.5 " + url.encode()))

    return Client


def test_downloads(spark, tmp_path):
    urls = ["fine", "huge", "gone", "page", "fake", "down", "grows", None, "fine2"]
    rows = spark.createDataFrame([(f"1/{k}", "t", u) for k, u in enumerate(urls)], "handle string, title string, url string")
    there = spark.createDataFrame([("1/8", 5000), ("1/0", 10)], "handle string, size_bytes long")
    files, told = f"file://{tmp_path}/files", f"file://{tmp_path}/told"
    sinks.write_downloads(sinks.download(rows, client(), there=there), files, told)
    got = {r["handle"]: r["status"] for r in spark.read.json(told).collect()}
    assert [got[f"1/{k}"] for k in range(9)] == ["ok", "skipped_too_large", "download_failed", "not_pdf", "invalid_pdf", "download_failed", "skipped_too_large", "no_pdf_url", "already_exists"]
    assert set(got.values()) <= set(sinks.DOWNLOAD)
    r = spark.read.parquet(files).first()
    assert (r["filename"], r["size_bytes"]) == ("1_0.pdf", 13) and spark.read.json(told).where("status = 'ok'").first()["md5"] == r["md5"]


def test_structuring_service(spark):
    waits = []

    def service(answers):
        left = list(answers)

        def post(name, content, flags, timeout):
            got = left.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return post

    one = lambda *answers: services.structure_one("a", b"x", service(answers), waits.append)
    assert one((200, "<TEI/>")) == ("ok", None, "<TEI/>")
    assert one((503, ""), (200, "<TEI/>"))[0] == "ok" and waits == [2]
    assert one((503, ""), (503, ""))[0] == "pending"
    assert one((500, "e" * 200)) == ("http_500", "e" * 150, None)
    assert one(TimeoutError(), TimeoutError())[0] == "timeout" and one(TimeoutError(), (200, "x"))[0] == "ok"
    assert one(ConnectionError("no"))[0] == "error"
    files = spark.createDataFrame([("1_2_3.pdf", bytearray(b"x")), ("1_4.pdf", bytearray(b"yy"))], "name string, content binary")
    make = lambda: lambda name, content, flags, timeout: (200, f"{name}{len(flags)}{timeout}")
    got = {r["handle"]: (r["name"], r["status"], r["tei"], r["size_bytes"]) for r in services.structure_files(files, make, 2).collect()}
    assert got == {"1/2_3": ("1_2_3.tei.xml", "ok", "1_2_3.pdf490", 1), "1/4": ("1_4.tei.xml", "ok", "1_4.pdf490", 2)}


def test_model_service():
    waits, asked = [], []

    def post(*answers):
        left = list(answers)

        def one(request, timeout):
            asked.append(request)
            got = left.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return one

    ask = lambda *answers: services.ask_model("p", post(*answers), services.is_json_object, "m", sleep=waits.append)
    assert ask((200, '{"a": 1}')) == '{"a": 1}' and asked[0]["options"]["num_predict"] == 1000
    assert ask((500, ""), (500, ""), (200, '{"a": ["x"')) == '{"a": ["x"' and waits == [1.0, 2.0]
    assert ask((200, ""), (200, "no object"), (200, "{}")) == "{}" and waits[2:] == [1.0]
    assert ask(OSError(), (500, ""), (500, "")) is None


def test_files_of_items(spark):
    rows = spark.createDataFrame([("1/1", "u", None), ("1/2", None, "s"), ("1/3", None, None), ("1/4", None, None), ("1/5", None, None)], "handle string, known string, scraped string")
    listing = json.dumps([{"bundleName": "THUMBNAIL", "name": "t.pdf"}, {"bundleName": "ORIGINAL", "name": "x.PDF", "link": "/f"}]).encode()

    def make():
        def get(url):
            if url.endswith("/handle/1/3?expand=none"):
                return b'{"id": 7}'
            if url.endswith("/handle/1/5?expand=none"):
                return b"not json"
            return listing if "/items/7/" in url else None

        return get

    got = {r["handle"]: r["url"] for r in services.resolve_pdf(rows, "https://r/rest", "https://r", make).collect()}
    assert got == {"1/1": "u", "1/2": "s", "1/3": "https://r/f", "1/4": None, "1/5": None}


PAGE = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header><identifier>oai:x:{n}</identifier><datestamp>2020</datestamp></header>
<metadata><d xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> T {n} </dc:title><dc:title>second</dc:title><dc:type>Tese</dc:type><dc:date>2011-01-01</dc:date><dc:creator>A</dc:creator><dc:creator> </dc:creator>
<dc:identifier>http://h/handle/{n}</dc:identifier><dc:identifier>http://h/{n}.PDF</dc:identifier></d></metadata></record>
<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"""
SETS = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListSets><set><setSpec>{n}</setSpec><setName>Set {n}</setName></set><resumptionToken>{token}</resumptionToken></ListSets></OAI-PMH>'


@pytest.fixture
def repository():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append(self.path)
            page = SETS if "ListSets" in self.path else PAGE
            n = self.path.rpartition("resumptionToken=")[2] if "resumptionToken" in self.path else ("s2-0" if "set=s2" in self.path else "s1-0")
            at = int(n.rpartition("-")[2])
            body = page.format(n=n, token="" if at == 2 else f"{n.rpartition('-')[0]}-{at + 1}").encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_sets_of_a_repository(repository):
    assert services.list_sets(repository[0]) == [("s1-0", "Set s1-0"), ("s1-1", "Set s1-1"), ("s1-2", "Set s1-2")]


def test_a_harvest_goes_on_where_it_stood(repository):
    url, seen = repository
    reader = services.OaiStream({"url": url, "sets": "s1,s2"})
    at, found = reader.initialOffset(), []
    for _ in range(4):
        rows, at = reader.read(at)
        found += [r[0] for r in rows]
    assert at == {"set": 1, "token": "s2-1", "seen": 4}
    again = services.OaiStream({"url": url, "sets": "s1,s2"})  # another process, from the offset alone
    while True:
        rows, end = again.read(json.loads(json.dumps(at)))
        found += [r[0] for r in rows]
        if end == at:
            break
        at = end
    assert found == [f"oai:x:{s}-{k}" for s in ("s1", "s2") for k in range(3)]
    assert [r[0] for r in again.readBetweenOffsets({"set": 0, "token": "s1-1", "seen": 1}, {"set": 1, "token": "", "seen": 3})] == ["oai:x:s1-1", "oai:x:s1-2"]


def test_streaming_harvest(spark, repository, tmp_path):
    spark.dataSource.register(services.OaiSource)
    rows = spark.readStream.format("oai").options(url=repository[0], sets="s1").load()

    def run():
        query = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").start()
        for _ in range(60):
            query.processAllAvailable()
            if (p := query.lastProgress) and p["numInputRows"] == 0:
                break
        query.stop()

    run()
    run()
    assert sorted(r["identifier"] for r in spark.read.parquet(f"file://{tmp_path}/out").select(F.col("identifier")).collect()) == ["oai:x:s1-0", "oai:x:s1-1", "oai:x:s1-2"]


def test_harvest_into_a_manifest(spark, repository, tmp_path):
    table, check = f"file://{tmp_path}/manifest", f"file://{tmp_path}/check"
    harvest.harvest_all(spark, repository[0], table, check, ["s1", "s2"], "http://h")
    rows = {r["handle"]: r for r in spark.read.parquet(table).collect()}
    assert set(rows) == {f"{s}-{k}" for s in ("s1", "s2") for k in range(3)}
    r = rows["s1-1"]
    assert (r["title"], r["creators"], r["handle_url"], r["pdf_url_oai"], r["types"]) == ("T s1-1", ["A"], "http://h/handle/s1-1", "http://h/s1-1.PDF", ["Tese"])
    asked = len(repository[1])
    harvest.harvest_all(spark, repository[0], table, check, ["s1", "s2"], "http://h")
    assert len(repository[1]) == asked and spark.read.parquet(table).count() == 6  # nothing is asked for twice


def test_graph_is_written_as_blocks(spark):
    g = triples(spark, [("a", "p", "1", "lit", "")])
    assert graph.turtle(g).first()["block"] == 'a\n    p "1" .'
