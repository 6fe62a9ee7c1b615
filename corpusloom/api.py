"""The steps of a collection, from harvest to report, under one name each."""

from .operators.comparison import compare
from .operators.discourse import analyze, diagnose_sections, enrich
from .operators.gates import gate_pdf, gate_tei
from .operators.structure import repair_titles, structure
from .plans.catalog import export
from .plans.report import build as report
from .plans.report import run_steps
from .plans.sparql import select
from .streaming.harvest import harvest_all
from .streaming.ingest import ingest

__all__ = ["analyze", "compare", "diagnose_sections", "enrich", "export", "gate_pdf", "gate_tei", "harvest_all", "ingest", "repair_titles", "report", "run_steps", "select", "structure"]
