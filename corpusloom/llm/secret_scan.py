"""Secret scans that link a credential's parts.

Strong parts are reported where they stand: assigned secrets, access identifiers and long hex runs.  Weak parts
(user or client names, endpoints, unassigned random-looking words) say little alone.  Within a text, an interval
join finds parts of complementary roles - identifier, secret, endpoint - whose distance is at most SCOPE; a weak part
is reported only when such a partner exists.  Intervals are sorted and searched by bisection, so a text with
many parts costs n log n steps, not pairs.

Defined results: a null or empty text has no spans.  Positions count code points; an end is exclusive.  Each row is
scanned by itself, so repeated rows and ids get equal rows, and a null doc_id stays null; of equally near partners the one
with the smaller position is linked; columns besides id and text pass through or don't matter; a text of any length is
scanned whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCOPE = 160
KINDS = ("assign", "access", "hex", "endpoint", "name", "random")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "endpoint": "endpoint", "name": "identifier", "random": "secret"}

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:[a-z0-9-]+\.)+amazonaws\.com\b|(?:endpoint|hostname|host)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", re.ASCII | re.IGNORECASE)
NAME = re.compile(r"""\b(?:username|user|login|client_?id|key_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = ("user", "login", "client", "key", "account")
_HOSTS = ("://", "amazonaws", "endpoint", "host")


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def random_looking(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.7


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    out = []
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def linked(parts: list[tuple[str, int, int]], scope: int = SCOPE) -> list[tuple[int, int]]:
    """For each part its nearest partner of another role within scope: pairs of positions in parts.

    Of each role the parts are kept sorted by start with running greatest ends, so one bisection on either side
    of a part decides."""
    by: dict[str, list[int]] = {}
    order = sorted(range(len(parts)), key=lambda k: parts[k][1:])
    for k in order:
        by.setdefault(ROLE[parts[k][0]], []).append(k)
    index = {}
    for role, at in by.items():
        reach, best = [], -1
        for j, k in enumerate(at):  # of the parts up to j, the one that reaches farthest
            if best < 0 or parts[k][2] > parts[at[best]][2]:
                best = j
            reach.append(best)
        index[role] = [parts[k][1] for k in at], reach
    out = []
    for k in order:
        kind, start, end = parts[k]
        near = []
        for role, (starts, reach) in index.items():
            if role == ROLE[kind]:
                continue
            j = bisect.bisect_left(starts, start)
            if j < len(starts):
                near.append((max(0, starts[j] - end), by[role][j]))
            if j:
                before = by[role][reach[j - 1]]
                near.append((max(0, start - parts[before][2]), before))
        if near and (best := min(near))[0] <= scope:
            out.append((k, best[1]))
    return out


def scan_text(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[str, int, int]], list[tuple[tuple, tuple]]]:
    """Reported spans, sorted by start, then kind as listed, and the links between parts."""
    if not text:
        return [], []
    low = text.lower()
    base = base_spans(text, low)
    weak = []
    if any(w in low for w in _HOSTS):
        weak += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if any(w in low for w in _NAMES):
        weak += [("name", m.start(), m.end()) for m in NAME.finditer(text)]
    if weak or any(k == "access" for k, _, _ in base):  # a secret alone has no partner
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        for m in RANDOM.finditer(text):
            j = bisect.bisect_left(starts, m.end())
            if not (j and taken[j - 1][1] > m.start()) and random_looking(m[0]):
                weak.append(("random", m.start(), m.end()))
    parts = base + weak
    pairs = linked(parts, scope) if len(parts) > 1 else []
    found = base + [parts[k] for k, _ in pairs if parts[k][0] not in BASE]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found, [(parts[a], parts[b]) for a, b in pairs]


def redact(text: str | None, spans) -> str | None:
    """The text with each reported stretch replaced by its first kind's name."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FIELDS = "doc_id long, spans array<struct<kind: string, start: int, end: int>>, links array<struct<kind: string, start: int, end: int, with_kind: string, with_start: int, with_end: int>>, redacted string"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, the reported spans, the links behind them and the redacted text of every document."""

    def run(parts):
        for ids, texts in parts:
            out = []
            for i, t in zip(ids, texts):
                spans, pairs = scan_text(t, scope)
                out.append((i, spans, [(*x, *y) for x, y in pairs], redact(t, spans)))
            yield out

    return C.map_texts(docs, run, FIELDS)


def redacted(docs: DataFrame, scope: int = SCOPE, text: str = "text") -> DataFrame:
    """The rows, all columns, with all reported stretches of one column replaced."""
    at = docs.columns.index(text)

    def run(batches, schema):
        for b in C.slices(batches, at):
            out = [redact(t, scan_text(t, scope)[0]) for t in b.column(at).to_pylist()]
            yield C.record_batch([out if k == at else c for k, c in enumerate(b.columns)], schema)

    return C.map_arrow(docs, run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select("doc_id", *map(count, BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("links").cast("long").alias("n_links"))
