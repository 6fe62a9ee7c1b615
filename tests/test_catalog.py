"""Every query that has SQL gives the same rows as DuckDB over the same tables."""

import numbers

import duckdb
import pandas as pd
import pytest
from corpusloom.plans import catalog, operator_queries
from corpusloom.sources.adapters import Corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: "null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("source,name", [(s, n) for s in (catalog, operator_queries) for n in s.names() if s.oracle(n)])
def test_same_rows_as_sql(spark, small, oracle, source, name):
    got = source.run(name, Corpus(spark, small)).toPandas()
    want = oracle.sql(source.oracle(name)).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_titles_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    texts = ["Ao dr. Silva, obrigado", "", None, "A real title of a work", "Dedico este trabalho a"]
    spark.createDataFrame([(3 * k + r, t) for k, t in enumerate(texts) for r in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"{k % 5}-X") for k in range(15)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("documents", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = operator_queries.run("PRJ16", Corpus(spark, str(tmp_path))).toPandas()
    assert rows(got) == rows(con.sql(operator_queries.oracle("PRJ16")).df())


def test_random_samples_are_repeatable(spark, small):
    for name in ("A07",):
        a, b = (catalog.run(name, Corpus(spark, small)).collect() for _ in range(2))
        assert a == b and 0 < len(a) <= 15


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())
