"""Outside services as injectable per-partition clients, and harvesting over OAI-PMH as a data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .workers import map_slices

#: Retries of a request, the factor between waits and the statuses that are tried again.
RETRIES, BACKOFF, AGAIN = 5, 3.0, (429, 500, 502, 503, 504)


def fetch(url: str, retries: int = RETRIES, backoff: float = BACKOFF, timeout: float = 60, opener=urllib.request.urlopen, sleep=time.sleep) -> bytes | None:
    """The body, or None once the retries are used up or the status is final."""
    for attempt in range(retries + 1):
        try:
            with opener(url, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN:
                return None
        except OSError:
            pass
        if attempt < retries:
            sleep(backoff * 2**attempt)
    return None


def with_client(rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[str], str]], concurrency: int | None = None) -> DataFrame:
    """(key, answer, error) of a client made once for each task and called for each row.

    concurrency is the number of partitions, so of calls at a time; an error is a value, not the job's end."""
    if concurrency:
        rows = rows.repartition(concurrency)

    def run(slices: Iterator[dict[str, list]]) -> Iterator[list[dict]]:
        client = make()
        for b in slices:
            out = []
            for k, t in zip(b[key], b[text]):
                try:
                    out.append({key: k, "answer": client(t)})
                except Exception as e:  # whatever a service raises
                    out.append({key: k, "error": f"{type(e).__name__}: {e}"})
            yield out

    return map_slices(rows.select(key, text), run, f"{key} {rows.schema[key].dataType.simpleString()}, answer string, error string")


# structuring PDF files

#: What is asked of the structuring service, how long it may take, tries, and what an error keeps.
STRUCTURE_FLAGS = {"consolidateHeader": "1", "consolidateCitations": "0", "includeRawCitations": "1", "includeRawAffiliations": "1"}
STRUCTURE_TIMEOUT, STRUCTURE_TRIES, ERROR_CHARS = 90, 2, 150
STRUCTURED = "handle string, name string, status string, error string, size_bytes long, tei string"


def structure_one(name: str, content: bytes, post, sleep=time.sleep) -> tuple[str, str | None, str | None]:
    """(status, error, document) of one file: a busy service is asked again after a short wait, a timeout too.

    post(name, content, flags, timeout) gives (HTTP status, text) and raises TimeoutError.  A service that stays busy
    leaves the file pending."""
    for attempt in range(1, STRUCTURE_TRIES + 1):
        try:
            code, text = post(name, content, STRUCTURE_FLAGS, STRUCTURE_TIMEOUT)
        except TimeoutError:
            if attempt == STRUCTURE_TRIES:
                return "timeout", f"{STRUCTURE_TIMEOUT}s, {attempt} tries", None
            sleep(2)
            continue
        except OSError as e:
            return "error", str(e), None
        if code == 200:
            return "ok", None, text
        if code != 503:
            return f"http_{code}", text[:ERROR_CHARS], None
        sleep(2 * attempt)
    return "pending", None, None


def structure_files(files: DataFrame, make: Callable[[], Callable], concurrency: int, sleep=time.sleep) -> DataFrame:
    """A row with status and document for each file (name, content).

    concurrency is the number of partitions, so of calls at a time; small files come first in each of them."""
    rows = files.select("name", "content", F.length("content").alias("size")).repartition(concurrency).sortWithinPartitions("size")

    def run(batches):
        post = make()
        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"]):
                status, error, tei = structure_one(name, content, post, sleep)
                stem = name.rpartition(".")[0]
                out.append((stem.replace("_", "/", 1), stem + ".tei.xml", status, error, len(content), tei))
            yield pd.DataFrame(out, columns=["handle", "name", "status", "error", "size_bytes", "tei"])

    return rows.select("name", "content").mapInPandas(run, STRUCTURED)


# language models

#: How a model is asked, how long it may take, and how often it is asked again.
MODEL_OPTIONS = {"temperature": 0.1, "top_p": 0.9, "num_predict": 1000, "num_ctx": 2048}
MODEL_TIMEOUT, MODEL_RETRIES = 120, 2


def ask_model(prompt: str, post, readable: Callable[[str], bool], model: str = "", retries: int = MODEL_RETRIES, sleep=time.sleep) -> str | None:
    """The model's answer, or None once the retries are used up.

    post(request, timeout) gives (HTTP status, answer text).  A bad status waits 1, 2, 4 ... seconds, an empty answer
    one; an answer that isn't readable is asked for again at once."""
    request = {"model": model, "prompt": prompt, "stream": False, "options": MODEL_OPTIONS}
    for attempt in range(retries + 1):
        wait = 0.0
        try:
            code, text = post(request, MODEL_TIMEOUT)
            if code == 200 and text and readable(text):
                return text
            wait = 2.0**attempt if code != 200 else 0.0 if text else 1.0
        except OSError:  # no answer in time is one more try
            pass
        if wait and attempt < retries:
            sleep(wait)
    return None


def is_json_object(text: str) -> bool:
    """Whether an answer holds a JSON object, whole or cut off after an item."""
    body = text.replace("```json", "").replace("```", "")
    body = body[body.find("{") :] if "{" in body else ""
    for tail in ("", "]" * max(0, body.count("[") - body.count("]")) + "}" * max(0, body.count("{") - body.count("}"))):
        try:
            return isinstance(json.loads(body.strip() + tail), dict)
        except ValueError:
            continue
    return False


# files of a repository item


def rest_pdf(bitstreams: Column, base: str) -> Column:
    """The link of the first original file that is a PDF by type or name, made absolute; null where there is none.

    bitstreams is an array of structs with bundleName, name, mimeType, retrieveLink and link."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    link = lambda b: F.coalesce(F.nullif(b["retrieveLink"], F.lit("")), F.nullif(b["link"], F.lit("")))
    fits = lambda b: F.coalesce((b["bundleName"] == "ORIGINAL") & (F.contains(low(b["mimeType"]), F.lit("pdf")) | F.endswith(low(b["name"]), F.lit(".pdf"))) & link(b).isNotNull(), F.lit(False))
    first = F.try_element_at(F.transform(F.filter(bitstreams, fits), link), F.lit(1))
    return F.when(F.startswith(first, F.lit("http")), first).otherwise(F.concat(F.lit(base), first))


BITSTREAMS = "array<struct<bundleName: string, name: string, mimeType: string, retrieveLink: string, link: string>>"


def resolve_pdf(rows: DataFrame, rest_url: str, base: str, make: Callable[[], Callable[[str], bytes | None]]) -> DataFrame:
    """(handle, url): the link already known, else the one found on the item's page, else that of the REST service.

    rows have handle, known and scraped links.  get(url) gives a body or None; it is asked for rows without a link alone."""
    found = rows.select("handle", F.coalesce("known", "scraped").alias("url"))

    def run(batches):
        get = make()

        def listed(handle):
            item = json.loads(get(f"{rest_url}/handle/{handle}?expand=none") or b"{}")
            key = item.get("id") or item.get("uuid")
            return get(f"{rest_url}/items/{key}/bitstreams?expand=none&limit=20") if key else None

        for b in batches:
            out = []
            for handle in b["handle"]:
                try:
                    body = listed(handle)
                except ValueError:
                    body = None
                out.append((handle, (body or b"[]").decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["handle", "listing"])

    asked = found.where("url is null").select("handle").mapInPandas(run, "handle string, listing string")
    rest = asked.select("handle", rest_pdf(F.from_json("listing", BITSTREAMS), base).alias("url"))
    return found.where("url is not null").unionByName(rest)


# harvesting

OAI = {"o": "http://www.openarchives.org/OAI/2.0/", "dc": "http://purl.org/dc/elements/1.1/"}
RECORD = "identifier string, datestamp string, sets array<string>, deleted boolean, fields map<string, array<string>>"


def records_of(page: bytes) -> tuple[list[tuple], str]:
    """Records of one page of ListRecords, and the token of the next ('' at the end)."""
    root, out = ET.fromstring(page), []
    for r in root.iterfind(".//o:record", OAI):
        head = r.find("o:header", OAI)
        fields: dict[str, list[str]] = {}
        for x in r.iterfind(".//o:metadata//*", OAI):
            if x.tag.startswith(f"{{{OAI['dc']}}}"):
                fields.setdefault(x.tag.rpartition("}")[2], []).append((x.text or "").strip())
        out.append((head.findtext("o:identifier", "", OAI), head.findtext("o:datestamp", "", OAI), [x.text for x in head.iterfind("o:setSpec", OAI)], head.get("status") == "deleted", fields))
    return out, (root.findtext(".//o:resumptionToken", "", OAI) or "").strip()


def sets_of(page: bytes) -> tuple[list[tuple[str, str]], str]:
    """(name, title) of the sets on one page of ListSets, and the token of the next."""
    root = ET.fromstring(page)
    found = [(x.findtext("o:setSpec", "", OAI), x.findtext("o:setName", "", OAI)) for x in root.iterfind(".//o:set", OAI)]
    return found, (root.findtext(".//o:resumptionToken", "", OAI) or "").strip()


def list_sets(url: str, get: Callable[[str], bytes | None] = fetch) -> list[tuple[str, str]]:
    """All sets of a repository."""
    out, asked = [], {"verb": "ListSets"}
    while True:
        page = get(f"{url}?{urllib.parse.urlencode(asked)}")
        if page is None:
            raise OSError(f"no answer from {url}")
        found, token = sets_of(page)
        out += found
        if not token:
            return out
        asked = {"verb": "ListSets", "resumptionToken": token}


def first_request(options: dict, set_name: str) -> dict:
    asked = {"verb": "ListRecords", "metadataPrefix": "oai_dc"} | {k: v for k in ("from", "until") if (v := options.get(k))}
    return asked | ({"set": set_name} if set_name else {})


def one_page(options: dict, asked: dict) -> tuple[list[tuple], str]:
    page = fetch(f"{options['url']}?{urllib.parse.urlencode(asked)}", retries=int(options.get("retries", RETRIES)))
    if page is None:
        raise OSError(f"no answer from {options['url']}")
    return records_of(page)


class OaiSource(DataSource):
    """spark.read.format("oai"): options url, sets (comma-separated; a partition each), from, until, limit.

    spark.readStream.format("oai") reads page after page, set after set; the offset is the resumption token, so the
    stream's checkpoint holds where a harvest stands."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return OaiReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return OaiStream(self.options)


class OaiStream(SimpleDataSourceStreamReader):
    """A page at a time.  An offset names the set, the token of its next page and the records seen."""

    def __init__(self, options):
        self.options = dict(options)
        self.sets = [x.strip() for x in self.options.get("sets", "").split(",")]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"set": 0, "token": "", "seen": 0}

    def _next(self, at: dict) -> tuple[list[tuple], dict]:
        if at["set"] >= len(self.sets):
            return [], at
        asked = {"verb": "ListRecords", "resumptionToken": at["token"]} if at["token"] else first_request(self.options, self.sets[at["set"]])
        rows, token = one_page(self.options, asked)
        return rows, {"set": at["set"] + (not token), "token": token, "seen": at["seen"] + len(rows)}

    def read(self, start: dict):
        rows, end = self._next(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        at = dict(start)
        while at != end:
            rows, after = self._next(at)
            yield from rows
            if after == at:
                return
            at = after


class SetPartition(InputPartition):
    pass


class OaiReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [SetPartition(x.strip()) for x in self.options.get("sets", "").split(",")]

    def read(self, partition):
        asked, left = first_request(self.options, partition.value), int(self.options.get("limit", "0")) or None
        while True:
            found, token = one_page(self.options, asked)
            for r in found:
                yield r
                if left is not None and (left := left - 1) == 0:
                    return
            if not token:
                return
            asked = {"verb": "ListRecords", "resumptionToken": token}


# diagnosis


def probe(rows: DataFrame, make: Callable[[], Callable[[str], bytes | None]]) -> DataFrame:
    """(endpoint, verb, status, n_records) of each pair of an endpoint and a verb, asked once: ok with the records or
    sets on the page, unreadable, or no_answer."""

    def run(batches):
        get = make()
        for b in batches:
            out = []
            for endpoint, verb in zip(b["endpoint"], b["verb"]):
                page = get(f"{endpoint}?verb={verb}&metadataPrefix=oai_dc" if verb == "ListRecords" else f"{endpoint}?verb={verb}")
                if page is None:
                    out.append((endpoint, verb, "no_answer", None))
                    continue
                try:
                    root = ET.fromstring(page)
                    out.append((endpoint, verb, "ok", sum(1 for _ in root.iter(f"{{{OAI['o']}}}record")) + sum(1 for _ in root.iter(f"{{{OAI['o']}}}set"))))
                except ET.ParseError:
                    out.append((endpoint, verb, "unreadable", None))
            yield pd.DataFrame(out, columns=["endpoint", "verb", "status", "n_records"]).astype({"n_records": "Int64"})

    return rows.select("endpoint", "verb").mapInPandas(run, "endpoint string, verb string, status string, n_records long")


def set_profile(records: DataFrame) -> DataFrame:
    """(set, type, year, n) of manifest records: what a set holds."""
    each = records.select(F.explode("sets").alias("set"), "types", "date").select("set", F.explode_outer("types").alias("type"), "date")
    return each.groupBy("set", "type", F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n"))
