"""Turtle files for interchange: prefixes, blocks of a subject with predicates and objects, literals with escapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:\#[^\n]*\s*)*(?:(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*")|(?P<iri><[^>]*>)|(?P<at>@[A-Za-z-]+)|(?P<dt>\^\^)|(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<name>[^\s"<>;,.()\[\]]*:(?:[^\s"<>;,()\[\]]*[^\s"<>;,.()\[\]])?|a(?=\s))|(?P<op>[.;,]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
PARSED = "file string, s string, p string, o string, o_kind string, o_dt string, error string"


class TurtleError(ValueError):
    """The text is not of the part of Turtle that is read."""


def _text(literal: str) -> str:
    body = literal[3:-3] if literal.startswith('"""') else literal[1:-1]
    plain = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), body, flags=re.S)
    return plain


def parse(text: str) -> list[tuple[str, str, str, str, str]]:
    """(s, p, o, o_kind, o_dt) of a text; full IRIs under a known prefix are shortened."""
    prefixes: dict[str, str] = {}
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"at {text[at : at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()

    def short(kind: str, x: str) -> str:
        if kind != "iri":
            return x
        for name, base in prefixes.items():
            if x[1:-1].startswith(base):
                return f"{name}:{x[1 + len(base) : -1]}"
        return x[1:-1]

    out, k = [], 0

    def take(*kinds: str) -> tuple[str, str]:
        nonlocal k
        if k >= len(tokens) or tokens[k][0] not in kinds:
            raise TurtleError(f"expected {kinds}, found {tokens[k] if k < len(tokens) else 'the end'}")
        k += 1
        return tokens[k - 1]

    while k < len(tokens):
        if tokens[k] == ("at", "@prefix"):
            k += 1
            name = take("name")[1].rstrip(":")
            prefixes[name] = take("iri")[1][1:-1]
            take("op")
            continue
        s = short(*take("name", "iri"))
        while True:
            p = short(*take("name", "iri"))
            while True:
                kind, x = take("name", "iri", "str", "num")
                dt = ""
                if kind == "str":
                    if k < len(tokens) and tokens[k][0] == "dt":
                        k += 1
                        dt = short(*take("name", "iri"))
                    elif k < len(tokens) and tokens[k][0] == "at":
                        dt = take("at")[1]
                    out.append((s, p, _text(x), "lit", dt))
                elif kind == "num":
                    out.append((s, p, x, "lit", "xsd:integer" if "." not in x else "xsd:decimal"))
                else:
                    out.append((s, p, short(kind, x), "iri", ""))
                end = take("op")[1]
                if end != ",":
                    break
            if end == ";" and k < len(tokens) and tokens[k] == ("op", "."):  # a semicolon may stand before the end
                k += 1
                end = "."
            if end == ".":
                break
    return out


def parse_table(files: DataFrame, name: str = "file", text: str = "value") -> DataFrame:
    """Triples of a table of texts; a text that can't be read gives one row with its error."""

    def run(batches):
        for b in batches:
            rows = []
            for f, t in zip(b["file"], b["value"]):
                try:
                    rows += [(f, *x, None) for x in parse(t or "")]
                except TurtleError as e:
                    rows.append((f, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "s", "p", "o", "o_kind", "o_dt", "error"])

    return files.select(F.col(name).alias("file"), F.col(text).alias("value")).mapInPandas(run, PARSED)


def read(spark: SparkSession, path: str, pattern: str = "*.ttl") -> DataFrame:
    """The triples (s, p, o, o_kind, o_dt) of the files of a folder that can be read; a file is one value."""
    whole = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = parse_table(whole.select(F.input_file_name().alias("file"), "value"))
    return rows.where("error is null").select("s", "p", "o", "o_kind", "o_dt")
