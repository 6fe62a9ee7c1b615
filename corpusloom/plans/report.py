"""Reports as Markdown from small aggregates, and the steps of a run with their log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.adapters import Corpus
from . import catalog

#: What stands for an empty table, and how much of a cell is shown.
NO_DATA, CELL = "_Sem dados._", 100

SECTIONS = [("Corpus", "R01"), ("Types", "R02"), ("Rhetorical classes", "R03"), ("Years", "R04"), ("Subjects", "R05"), ("Items", "R06"), ("Density", "R07"), ("Topics", "R08"), ("Limitations by area", "R09"), ("Cited references", "R10"), ("Keywords", "R11"), ("Quantitative claims", "R12"), ("Works with most limitations", "R13"), ("Future work by area", "R14")]


def markdown(names: list[str], rows) -> str:
    cell = lambda v: ("" if v is None else str(v))[:CELL].replace("|", "\\|").replace("\n", " ")
    lines = [names, ["---"] * len(names), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table: cells cut, bars escaped."""
    rows = df.limit(most).collect()
    return markdown(df.columns, rows) if rows else NO_DATA


def ratio(a: float, b: float) -> float:
    return a / max(b, 1)


def build(corpus: Corpus, sections=None) -> str:
    parts = ["# Corpus report"]
    for title, name in SECTIONS if sections is None else sections:
        parts += [f"\n## {title}\n", table(catalog.run(name, corpus))]
    return "\n".join(parts) + "\n"


def comparison(scored: DataFrame) -> str:
    """Scored models (see operators.comparison), the best first, with the one to take."""
    figures = ["model", "score", "n", "errors", "json_fail", "avg_specific", "avg_gen_ratio", "avg_fields", "avg_kw", "avg_time", "tps", "est_h"]
    rows = scored.select(*figures).limit(100).collect()
    best = [r["model"] for r in rows if r["score"] == rows[0]["score"]] if rows else []
    why = "most points" if len(best) == 1 else "equal points, less time"
    told = f"Take **{rows[0]['model']}**: {why}." if rows else NO_DATA
    return "\n".join(["# Comparison of models", "", markdown(figures, rows) if rows else NO_DATA, "", told]) + "\n"


def run_steps(steps: list[tuple[str, Callable[[], object]]], from_step: str | None = None, only: str | None = None, skip: tuple[str, ...] = (), dry_run: bool = False, stop: bool = True) -> list[dict]:
    """Run named steps in order; a log row each with status ok, error, skipped or planned."""
    names = [k for k, _ in steps]
    for x in (from_step, only):
        if x is not None and x not in names:
            raise KeyError(x)
    start, out, failed = names.index(from_step) if from_step else 0, [], False
    for k, (name, f) in enumerate(steps):
        row = {"step": name, "status": "ok", "seconds": 0.0, "error": None}
        out.append(row)
        if k < start or (only and name != only) or name in skip or (failed and stop):
            row["status"] = "skipped"
        elif dry_run:
            row["status"] = "planned"
        else:
            began = time.time()
            try:
                f()
            except Exception as e:  # a step's failure is a row of the log
                row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                failed = True
            row["seconds"] = round(time.time() - began, 3)
    return out


def duration(seconds: float) -> str:
    """Hours, minutes and seconds, the larger parts left out while they are zero."""
    s = int(seconds)
    return f"{s // 3600}h {s % 3600 // 60}m {s % 60}s" if s >= 3600 else f"{s // 60}m {s % 60}s" if s >= 60 else f"{s}s"
