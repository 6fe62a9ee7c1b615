"""A corpus pipeline over documents: toxicity, line dedup, near duplicates, secrets, packing.

Each stage takes the rows that the stage before it kept and, but for the last, returns them with the columns of
documents.  Defined results: rows with null texts pass as empty ones; columns besides id, text and n_chars pass through,
whatever their names; an empty table passes through.  Rows are told apart by id and text: of a group of near duplicates
the row with the smallest doc_id stays (rows without one come last), and different texts under one doc_id both stay
unless they are near duplicates.  A line of ten rows or more stays in the rows that have the smallest doc_id of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, line_dedup, packing, secret_scan, toxicity
from corpusloom.llm.common import forget, load, stash
from corpusloom.llm.queries import fold_of, vocabulary

TOXIC = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where there is one."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under TOXIC; labels of the held-out fifth are not learned from."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), where=fold_of() != 0)
    return toxicity.below(docs, model, TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first of them alone; a document that loses all its lines goes."""
    out = line_dedup.with_kept(docs, keep_first=True)
    kept = out[out.columns[-1]]
    out = out.where((kept["n_dropped"] == 0) | (F.trim(kept["text"], F.lit(" \t\n\x0b\x0c\r")) != ""))
    return _counted(out.withColumn("text", kept["text"])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each reported stretch replaced by its kind."""
    return _counted(secret_scan.redacted(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The stages hold a trained machine and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
