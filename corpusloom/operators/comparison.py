"""Comparison of language models by what they extract: quality of an answer, figures of a model, and a choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_generic

#: The lists that count, words that are no keywords here, and the shortest keyword.
FIELDS = ["claims", "contributions", "limitations", "future_work"]
STOP = [
    "results", "resultados", "conclusion", "conclusão", "methodology", "simulation", "simulação", "research", "pesquisa",
    "analysis", "análise", "work", "trabalho", "method", "approach", "study", "data", "dados", "model", "modelo", "system",
    "sistema",
]
KEYWORD_CHARS = 5
#: The corpus that hours are estimated for and how many calls run at a time.
CORPUS, AT_ONCE = 1970, 3
#: The points of a model, as (figure, comparison, bound, points).
POINTS = [("errors", "==", 0, 3), ("avg_gen_ratio", "<", 0.25, 3), ("avg_specific", ">=", 3.0, 2), ("avg_fields", ">=", 3.5, 2), ("json_fail", "==", 0, 2), ("avg_kw", ">=", 3.0, 1)]

ANSWER = "claims array<string>, contributions array<string>, limitations array<string>, future_work array<string>, keywords_inferred array<string>, rhetorical_type string"


def answer_json(raw: Column) -> Column:
    """The first readable one of: the answer, what follows its first brace, and each of them with brackets or with braces
    closed, not both; null where none is."""
    clean = F.replace(F.trim(F.regexp_replace(raw, r"```(?:json)?\s*", "")), F.lit("```"), F.lit(""))
    body = F.regexp_extract(clean, r"(?s)(\{.*)", 1)
    open_ = lambda x, a, b: F.greatest(F.regexp_count(x, F.lit(a)) - F.regexp_count(x, F.lit(b)), F.lit(0))
    forms = [y for x in (clean, body) for y in (x, F.concat(x, F.repeat(F.lit("]"), open_(x, r"\[", r"\]"))), F.concat(x, F.repeat(F.lit("}"), open_(x, r"\{", r"\}"))))]
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in forms))


def quality(samples: DataFrame, answer: str = "answer") -> DataFrame:
    """The samples with a column q: what is in an answer's lists, how much of it says something, which lists are empty."""
    got = F.from_json(answer_json(F.col(answer)), ANSWER)
    none = F.array().cast("array<string>")
    lists = {k: F.filter(F.coalesce(got[k], none), lambda x: x.isNotNull() & (F.trim(x) != "")) for k in FIELDS}
    items = F.concat(*lists.values())
    dull = F.size(F.filter(items, lambda x: is_generic(x)))
    words = F.filter(F.coalesce(got["keywords_inferred"], none), lambda k: (F.length(k) >= KEYWORD_CHARS) & ~F.lower(F.trim(k)).isin(*STOP))
    kind = F.coalesce(got["rhetorical_type"], F.lit(""))
    valid = answer_json(F.col(answer)).isNotNull()
    counts = F.create_map(*(x for k, v in lists.items() for x in (F.lit(k), F.size(v))))
    full = F.struct(
        F.lit(True).alias("valid_json"), F.size(items).alias("total"), (F.size(items) - dull).alias("specific"), dull.alias("generic"),
        (dull / F.greatest(F.size(items), F.lit(1))).alias("generic_ratio"), counts.alias("fields"),
        F.array_compact(F.array(*(F.when(F.size(v) == 0, F.lit(k)) for k, v in lists.items()))).alias("missing"),
        ((kind != "") & (kind != "mixed")).alias("rhet_ok"), F.size(words).alias("keywords_ok"),
    )
    zero = F.lit(0)
    empty = F.struct(F.lit(False).alias("valid_json"), zero.alias("total"), zero.alias("specific"), zero.alias("generic"), F.lit(1.0).alias("generic_ratio"), F.create_map().cast("map<string,int>").alias("fields"), none.alias("missing"), F.lit(False).alias("rhet_ok"), zero.alias("keywords_ok"))
    return samples.withColumn("q", F.when(valid, full).otherwise(empty))


def mean2(x: Column) -> Column:
    """A mean to two digits, 0 over no rows; ties go to the even digit."""
    return F.coalesce(F.bround(F.avg(x), 2), F.lit(0.0))


def models(judged: DataFrame) -> DataFrame:
    """One row per model of judged samples (model, time, tokens, error, q): mean time and tokens, failures, and means of
    what valid answers hold."""
    valid = F.col("q.valid_json")
    over = lambda x: mean2(F.when(valid, x))
    error = F.coalesce("error", F.lit(""))
    filled = reduce(lambda a, b: a + b, (F.when(F.col("q.fields")[k] > 0, 1).otherwise(0) for k in FIELDS))
    out = judged.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(error != "").alias("errors"), F.count_if(F.contains(error, F.lit("timeout"))).alias("timeouts"),
        F.count_if(~valid).alias("json_fail"), F.count_if(F.array_contains("q.missing", "claims")).alias("missing_claims"),
        mean2(F.col("time")).alias("avg_time"), mean2(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("avg_tokens"),
        over(F.col("q.specific")).alias("avg_specific"), over(F.col("q.generic")).alias("avg_generic"), over(F.col("q.generic_ratio")).alias("avg_gen_ratio"),
        over(F.col("q.total")).alias("avg_total"), over(filled).alias("avg_fields"), over(F.col("q.keywords_ok")).alias("avg_kw"),
        F.count_if(valid & F.col("q.rhet_ok")).alias("rhet_ok"), *(over(F.coalesce(F.col("q.fields")[k], F.lit(0))).alias(f"avg_{k}") for k in FIELDS),
    )
    speed = F.when(F.col("avg_time") > 0, F.bround(F.col("avg_tokens") / F.col("avg_time"), 1)).otherwise(0.0)
    return out.withColumns({"tps": speed, "est_h": F.bround(F.col("avg_time") * CORPUS / AT_ONCE / 3600, 1)})


def score(figures: DataFrame) -> DataFrame:
    """The models with their points."""
    tests = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b}
    points = reduce(lambda a, b: a + b, (F.when(tests[op](F.col(k), F.lit(v)), n).otherwise(0) for k, op, v, n in POINTS))
    return figures.withColumn("score", points.cast("long"))


def recommend(scored: DataFrame) -> DataFrame:
    """The model with most points; of equal ones the faster, then the first by name."""
    return scored.orderBy(F.desc("score"), "avg_time", "model").limit(1)


def compare(samples: DataFrame) -> DataFrame:
    """Samples (model, answer, time, tokens, error) to scored models, the best first."""
    return score(models(quality(samples))).orderBy(F.desc("score"), "avg_time", "model")
