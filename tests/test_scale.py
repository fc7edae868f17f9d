"""Searches over whole tables without a row a posting, pair or query: the same results as the plain way, and bounded rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import dense, lexical, passages, topology, walk

ODD = ["the cat-flap is on the-mat, re-use", "São Paulo não é o Rio — ação", "это книга и не та", "한국어 문장 이 그", "これは本です の に", "中文句子 的 了", "¿qué tal? el la los", "für die Straße ÄÖ", "un œuf et le", "K İstanbul ẞ a_b-c--d x-", "áé xyz", "", None, "   ", "a a a b-b b", "il gatto non sono gli della"]


def shuffled(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_in_python_are_those_of_the_columns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    want = {r.id: (r.lang, r.terms) for r in lexical.term_lists(df).collect()}
    assert {i: X.terms(t) for i, t in enumerate(ODD)} == want


def test_index_counts_in_place(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    index = lexical.build_index(df)
    lists = {r.id: r.terms for r in lexical.term_lists(df).collect()}
    want = {(i, t, terms.count(t), max(1, len(terms))) for i, terms in lists.items() for t in terms}
    assert {(r.id, r.term, r.tf, r.dl) for r in index.postings.collect()} == want
    assert "Exchange" not in shuffled(index.postings)  # it was dealt out by id and term before
    assert {r.term: r.df for r in index.terms.collect()} == {t: sum(t in x for x in lists.values()) for x in lists.values() for t in x}


def test_index_of_repeated_ids(spark):
    rows = [(1, "alpha beta"), (1, "beta gamma"), (1, "delta"), (2, "alpha beta"), (3, "")]
    index = lexical.build_index(spark.createDataFrame(rows, "id int, text string"))
    assert sorted((r.id, r.term, r.tf, r.dl) for r in index.postings.collect()) == [(1, "alpha", 1, 2), (1, "beta", 2, 2), (1, "delta", 1, 1), (1, "gamma", 1, 2), (2, "alpha", 1, 2), (2, "beta", 1, 2)]
    assert {r.term: r.df for r in index.terms.collect()} == {"alpha": 2, "beta": 2, "gamma": 1, "delta": 1} and index.n == 5


def test_bm25_of_blocks_without_a_query_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "gamma")], "id int, text string").repartition(4, "id")
    got = lexical.bm25(lexical.build_index(docs), spark.createDataFrame([(7, "gamma"), (8, "absent")], "qid int, text string"))
    assert [(r.qid, r.id, r["rank"]) for r in got.collect()] == [(7, 4, 1)]


@pytest.mark.parametrize("tie", [False, True])
def test_best_of_blocks(tie):
    rng = np.random.default_rng(5)
    s, hops, ids = rng.integers(0, 6, (500, 7)) / 2.0, rng.integers(0, 3, 500), rng.permutation(500)
    s[rng.random((500, 7)) < 0.3] = -np.inf
    best, was = lexical.Best(7, 9), lexical.CELLS
    lexical.CELLS = 100
    try:
        for lo in range(0, 500, 60):
            best.add(pa.array(ids[lo : lo + 60]), lambda i, j: s[lo : lo + 60, i:j], hops[lo : lo + 60] if tie else None)  # noqa: B023
            assert best.held <= 2 * 7 * 60  # what waits is bounded, whatever came before
        got = [x for b in best.batches() for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    finally:
        lexical.CELLS = was
    want = [(q, int(ids[r]), s[r, q]) for q in range(7) for r in sorted(np.flatnonzero(s[:, q] > -np.inf), key=lambda r: (-s[r, q], hops[r] if tie else 0, ids[r]))[:9]]
    assert got == want


@pytest.mark.parametrize("tie", [False, True])
@pytest.mark.parametrize("digits", [(), (6,)])
def test_best_holds_k_a_query_of_equal_scores(tie, digits):
    rng = np.random.default_rng(11)
    n, k = 4000, 5
    v, m, ids, hops = np.repeat(rng.normal(size=(4, 3)), n // 4, axis=0)[rng.permutation(n)], rng.normal(size=(40, 3)), rng.permutation(n), rng.integers(0, 3, n)
    s, which = np.round(v @ m.T, 6), np.arange(3, 35)
    best = lexical.Best(40, k, *digits)
    for lo in range(0, n, 500):
        b = slice(lo, lo + 500)
        best.add(pa.array(ids[b]), lambda i, j, b=b: v[b] @ m[which[i:j]].T if digits else s[b, which[i:j]], hops[b] if tie else None, which)
        assert best.held <= len(which) * k * (lo // 500 + 1)  # each copy of the best vector waited before
    got = [x for c in best.batches() for x in zip(*(y.to_pylist() for y in c.columns), strict=True)]
    assert got == [(q, int(ids[r]), s[r, q]) for q in which for r in sorted(range(n), key=lambda r, q=q: (-s[r, q], hops[r] if tie else 0, ids[r]))[:k]]


def test_best_settles_at_k_a_query():
    rng = np.random.default_rng(12)
    v, m, k = rng.normal(size=(12_000, 8)), rng.normal(size=(1500, 8)), 40
    best = lexical.Best(len(m), k)
    for lo in range(0, len(v), 2000):
        best.add(pa.array(np.arange(lo, lo + 2000)), lambda i, j, b=v[lo : lo + 2000]: np.round(b @ m[i:j].T, 6))
        assert best.held < len(m) * k  # it grew to CELLS, k a query and block, before
    assert sum(b.num_rows for b in best.batches()) == len(m) * k


def test_search_task_holds_no_more_for_more_rows():
    """The arms of the fusion queries: numpy's peak in a task of 1,500 queries over one and over four batches of 10,000 rows."""
    rng = np.random.default_rng(13)

    class Vectors:
        dtypes = [("id", "bigint"), ("vector", "array<float>")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            raise StopIteration(run)

    def batches(n):
        for i in range(n):
            v = pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=160_000).astype(np.float32)), 16).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * 10_000, (i + 1) * 10_000)), v], names=["id", "vector"])

    with pytest.raises(StopIteration) as caught:
        dense._block_top_k(Vectors(), list(range(1500)), rng.normal(size=(1500, 16)), 50, "bigint")
    peaks = []
    for n in (1, 4):
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in caught.value.value(batches(n))) == 1500 * 50
            peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        finally:
            tracemalloc.stop()
    assert peaks[1] < 60 and peaks[1] < 1.3 * peaks[0]  # 32 and 32 MB; 57 and 123 with hits that waited, 363 and 483 with whole score matrices


def test_hashed_top_k_is_the_exact_one(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{j}" for j in rng.zipf(1.4, 30) if j < 500)) for i in range(300)] + [(300, ""), (301, None)]
    index = lexical.build_index(spark.createDataFrame(rows, "id int, text string"))
    q = spark.createDataFrame([(1, "w1 w2 w7"), (2, "w30 w31"), (3, "absent")], "qid int, text string")
    terms = lexical.query_terms(q).select(F.col("qid").alias("id"), "term", F.col("times").alias("tf"))
    qv = dense.hashed(index, terms).withColumnRenamed("id", "qid")
    want = dense.exact_top_k(dense.hashed(index, index.postings), qv, 20).collect()
    assert sorted(map(tuple, dense.hashed_top_k(index, qv, 20).collect())) == sorted(map(tuple, want)) and want


def test_top_k_returns_k_a_task(spark):
    v = np.random.default_rng(6).normal(size=(3000, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(1).cache()
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = dense._block_top_k(df, [1, 2], v[:2], 5, "long")
        assert found.count() == 10  # 5 a query and batch before
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_holders_and_evidence(spark):
    docs = ["xx abcdefgh-tail yy", "abcdefgh-tai", "abcdefgh-tail", "ção çã", "aaaaaaaaaaaaaaaaaaaaab", "", None, "tail", "Alpha BETA gamma Kelvin", "alpha alpha beta", "one two three four five six", "12 345 ab"]
    asked = ["abcdefgh-tail", "ail", "ção", "", "aaaaaaaab", "q", None, "ã", "Alpha beta gamma", "345 alpha", "K kelvin"]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    got = passages.holders(d, q)
    assert {(r.qid, r.id) for r in got.collect()} == {(j, i) for i, t in enumerate(docs) for j, x in enumerate(asked) if t is not None and x is not None and x in t}
    assert "NestedLoop" not in shuffled(got)
    a = d.select("id", X.evidence_tokens(F.col("text")).alias("a"))
    want = a.crossJoin(q.select("qid", X.evidence_tokens(F.col("text")).alias("b"))).filter(X.evidence_hit(F.col("a"), F.col("b"))).select("id", "qid")
    hit = passages.evidence(d, q)
    assert sorted(map(tuple, hit.collect())) == sorted(map(tuple, want.collect())) and "NestedLoop" not in shuffled(hit)


def test_basins_are_scored_in_blocks(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(90, 3)), 1)
    rows = [(i, i % 9, i // 9, v[i].tolist(), rng.normal(size=3).tolist() if i < 4 else None) for i in range(90)]
    m = spark.createDataFrame(rows, "id long, basin_id long, hops int, vector array<double>, summary array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 90, 11)] + [(99, [0.0, 0.0, 0.0])], "qid long, vector array<double>")
    cos = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1)), 6)
    want = set()
    for i in range(0, 90, 11):
        heads = sorted(((-(cos(v[i], rows[b][4]) if b < 4 and cos(v[i], rows[b][4]) else cos(v[i], v[b])), b) for b in range(9)))
        if -heads[0][0] > 1e-9:
            for place, (_, b) in enumerate(heads[:3], 1):
                inside = sorted((-cos(v[i], v[x]), x // 9, x) for x in range(b, 90, 9))[:4]
                want |= {(i, b, place, x, r) for r, (_, _, x) in enumerate(inside, 1)}
    got = dense.basin_search(m, q, 3, 4)
    assert {(r.qid, r.basin_id, r.basin_rank, r.id, r["rank"]) for r in got.collect()} == want


def test_nearest_pairs_make_the_same_virtual_edges(spark):
    v = np.round(np.random.default_rng(9).normal(size=(260, 3)), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    every, some = dense.similar_pairs(df, 0.3), dense.nearest_pairs(df, 0.3, 12).cache()
    assert some.count() <= 12 * 260 < every.count()
    want = topology.virtual_edges(every, 5, (4, 12))
    assert sorted(map(tuple, topology.virtual_edges(some, 5, (4, 12)).collect())) == sorted(map(tuple, want.collect()))


def test_entity_walk_is_the_entity_search(spark):
    rng = np.random.default_rng(10)
    names = [f"HttpServer{i}" if i % 3 else f"parse_item{i}" for i in range(40)]
    rows = [(i, " ".join(names[j % 40] for j in rng.zipf(1.5, 12))) for i in range(120)] + [(120, ""), (121, None), (122, "ÉCLAIR lonely_Name9 XMLHttp2")]
    d = spark.createDataFrame(rows, "id long, text string")
    assert {(r.id, e) for r in walk.entity_lists(d).collect() for e in r.entities} == {(r.id, r.entity) for r in walk.entities(d).collect()}
    q = spark.createDataFrame([(1, "httpserver1"), (1, "http"), (2, "item3"), (3, "unknown"), (4, "lonely_name9")], "qid long, entity string")
    want = walk.entity_search(walk.entities(d), q, documents=len(rows)).collect()
    was, walk.ROWS, walk.PART = walk.ROWS, 7, 20
    try:
        got = walk.entity_walk(d, q).collect()
    finally:
        walk.ROWS, walk.PART = was, 50_000
    key = lambda rs: sorted((r.qid, r["rank"], r.id, round(r.score, 5)) for r in rs)
    assert key(got) == key(want) and want
