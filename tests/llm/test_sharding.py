import math
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import sharding as S


def test_matrix_has_exact_margins_and_the_right_law():
    counts, sizes = [5, 0, 9, 2], S.shard_sizes(16, 3)
    draws = [S.communication_matrix(counts, sizes, seed) for seed in range(3000)]
    for m in draws:
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()
    mean = np.mean(draws, axis=0)
    assert np.allclose(mean, np.outer(counts, sizes) / 16, atol=0.08)
    var = np.var([m[2, 0] for m in draws])
    want = 9 * (6 / 16) * (10 / 16) * (7 / 15)
    assert abs(var - want) < 0.1
    with pytest.raises(ValueError):
        S.communication_matrix([1], [2], 0)


def test_any_population():
    """Beyond the range of numpy's generator: margins exact, mean and variance of the law."""
    m = S.communication_matrix([3 * 10**9, 10**9], S.shard_sizes(4 * 10**9, 7), 1)
    assert m.sum(axis=1).tolist() == [3 * 10**9, 10**9] and m.min() > 0
    rng = np.random.default_rng(3)
    for good, bad, draws in ((6 * 10**8, 10**10 - 6 * 10**8, 10**7), (10**12, 15 * 10**12, 2 * 10**9), (10**10, 10, 5 * 10**9), (3, 10**10, 4 * 10**9)):
        got = np.asarray([S._hypergeometric(rng, good, bad, draws) for _ in range(4000)], float)
        n = good + bad
        mean, var = draws * good / n, draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))
        assert abs(got.mean() - mean) < 5 * (var / 4000) ** 0.5 and abs(got.var() / var - 1) < 0.15


def test_the_large_sampler_has_the_law_of_the_exact_one():
    rng = np.random.default_rng(5)
    for good, bad, draws in ((30, 50, 20), (2, 9, 5), (500, 20, 100)):
        got = Counter(S._hypergeometric_large(rng, good, bad, draws) for _ in range(20_000))
        total = math.comb(good + bad, draws)
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            p = math.comb(good, k) * math.comb(bad, draws - k) / total
            assert abs(got[k] - 20_000 * p) < 5 * (20_000 * p * (1 - p)) ** 0.5 + 1


def test_a_long_plan_is_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 3)
    monkeypatch.setattr(S, "MOST_SOURCES", 4)
    check(S.shard(spark.range(0, 900, 1, 10), 4).collect(), 900, 4)


def test_very_long_texts(spark):
    df = spark.createDataFrame([(i, "ü" * (1_000_000 if i % 50 == 0 else 3)) for i in range(100)], "doc_id long, text string")
    got = S.shard(df, 8).collect()
    check(got, 100, 8)
    assert sorted(len(r.text) for r in got)[-2:] == [1_000_000] * 2


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_rows_of_all_kinds(spark):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else "t" * (i % 3), "x") for i in range(300)] + [(1, "same", "x")] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = S.shard(df, 7).collect()
    check(got, 450, 7)
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    assert len({r.shard for r in got if r.text == "same"}) == 7
    assert S.shard(df.filter("false"), 4).count() == 0
    check(S.shard(df.limit(3), 16).collect(), 3, 16)
    with pytest.raises(ValueError):
        S.shard(df.withColumnRenamed("source", "slot"))


def test_shards_and_slots_are_uniform(spark):
    got = S.shard(spark.range(0, 16000, 1, 8), 8).collect()
    check(got, 16000, 8)
    first = Counter(r.shard for r in got if r.id < 2000)  # rows of one source go everywhere
    assert min(first.values()) > 180 and max(first.values()) < 320
    early = sum(r.slot for r in got if r.id < 8000) / 8000
    assert abs(early - 999.5) < 25
    other = {r.id: r.shard for r in S.shard(spark.range(0, 16000, 1, 8), 8, seed=9).collect()}
    assert 1700 < sum(other[r.id] == r.shard for r in got) < 2300


def test_query(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = S.op2_sharding(spark, d).collect()
    check(got, len(text), 16)
    for r in got:
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
