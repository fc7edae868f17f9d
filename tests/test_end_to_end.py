"""Every core query with an oracle gives the oracle's rows, and a small search finds what it should."""

import math

import duckdb
import pytest

from corpusflow.operators import fusion, metrics
from corpusflow.plans import registry, search
from corpusflow.sources import datasets

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "conversations", "events", "labels", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)
    spark.catalog.clearCache()


def test_small_search(spark):
    corpus, asked = datasets.mini_corpus(spark)
    run = fusion.ranked(search.flat_hybrid(corpus, asked.select("qid", "text")).hybrid).withColumnRenamed("id", "doc_id")
    s = metrics.summary(metrics.per_query(run, asked.select("qid", "doc_id"))).first()
    assert s.mrr >= 0.9 and s.ndcg >= 0.9 and s.recall >= 0.95
