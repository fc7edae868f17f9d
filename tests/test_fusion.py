import pytest

from corpusflow.operators import fusion, metrics
from corpusflow.plans import registry_graph


def hits(spark, rows, columns="qid string, id string, doc_id string, score double, rank int"):
    return spark.createDataFrame(rows, columns)


def test_rrf_allowlist_keeps_ranks(spark):
    a = hits(spark, [("q", "both", 1), ("q", "lexical", 2), ("q", "deep", 3)], "qid string, id string, rank int")
    b = hits(spark, [("q", "both", 1), ("q", "semantic", 2)], "qid string, id string, rank int")
    got = {r.id: r.score for r in fusion.weighted_rrf(a, b, 0.6, k=10, depth=2).collect()}
    assert got == {"both": round(0.6 / 11 + 0.4 / 11, 8), "lexical": 0.05, "semantic": round(0.4 / 12, 8)}
    late = hits(spark, [("q", "out", 1), ("q", "semantic", 2)], "qid string, id string, rank int")
    got = {r.id: r.score for r in fusion.weighted_rrf(late, b, 0.6, k=10, allow=b).collect()}
    assert got["semantic"] == round(0.6 / 12 + 0.4 / 12, 8) and "out" not in got


def test_diversify(spark):
    h = hits(spark, [("q", "a0", "a", 3.0, 1), ("q", "a1", "a", 2.9, 2), ("q", "b0", "b", 2.5, 3)])
    for k, want in ((2, ["a0", "b0"]), (3, ["a0", "b0", "a1"])):
        assert [r.id for r in fusion.diversify(h, k).orderBy("rank").collect()] == want


def test_rescue(spark):
    order = hits(spark, [("q", "d0", "d0", 1.0, 1), ("q", "d1", "d1", 0.9, 2)])
    bm = hits(spark, [("q", "lex", "lex", 9.0, 1), ("q", "d0", "d0", 8.0, 2)])
    dense = hits(spark, [("q", "d0", "d0", 1.0, 1), ("q", "d1", "d1", 1.0, 2)])
    assert [r.id for r in fusion.rescue(order, bm, dense, 3).orderBy("rank").collect()] == ["d0", "d1", "lex"]
    assert [r.id for r in fusion.rescue(order, bm, dense, 2).orderBy("rank").collect()] == ["d0", "lex"]


def test_hops_neutral_and_penalty(spark):
    s = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0)], "qid string, id string, score double")
    h = spark.createDataFrame([("q", "a", 2)], "qid string, id string, hop int")
    neutral = {r.id: r.score for r in fusion.hop_prior(s, h).collect()}
    penalty = {r.id: r.score for r in fusion.hop_prior(s, h, "penalty").collect()}
    assert neutral["b"] == 1.0 and penalty["b"] < penalty["a"] == neutral["a"] < 1.0


def test_metrics(spark):
    run = spark.createDataFrame([("q", "x", 1), ("q", "gold", 2), ("r", "gold", 1), ("r", "gold", 2)], "qid string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "gold"), ("r", "gold"), ("r", "second"), ("s", "none")], "qid string, doc_id string")
    got = {r.qid: r for r in metrics.per_query(run, rel).collect()}
    assert got["q"].mrr == 0.5 and got["r"].recall == 0.5 and got["s"].ndcg == 0.0 and got["s"].hit == 0.0


def test_file_recall(spark):
    run = spark.createDataFrame([("q", "README.md", 1), ("q", "a.py", 2), ("q", "b.py", 3)], "qid string, path string, rank int")
    gold = spark.createDataFrame([("q", "a.py"), ("q", "c.py")], "qid string, path string")
    r = metrics.file_recall(run, gold).first()
    assert (r.recall, r.any, r.all, r.mrr) == (0.5, True, False, 1.0)


@pytest.mark.parametrize(("control", "gain", "complete", "want"), [(0.70, 0.02, True, "CONTINUE_B"), (0.70, 0.0, True, "CONVERT_C"), (0.71, 0.02, True, "GATE_INVALID"), (0.70, 0.02, False, "GATE_INVALID")])
def test_gate(control, gain, complete, want):
    assert metrics.gate_decision(control, 0.70, gain, 0.74, 0.745, complete) == want


def test_passages_and_means(spark):
    run = spark.createDataFrame([("q", 1, "alpha beta gamma delta"), ("q", 2, "nothing else")], "qid string, rank int, text string")
    gold = spark.createDataFrame([("q", "alpha beta gamma"), ("q", "missing words entirely")], "qid string, gold string")
    r = metrics.passage_recall(run, gold).first()
    assert (r.hit, r.covered) == (1.0, 0.5)
    t = spark.createDataFrame([("a", 0.5, True, False), ("b", 0.7, True, False)], "task string, score double, complete boolean, sampled boolean")
    assert metrics.complete_mean(t, 2).first()["mean"] == 0.6 and metrics.complete_mean(t, 3).first()["mean"] is None


def test_passages_late_in_a_document(spark, tmp_path):
    filler = " ".join(f"filler{i % 7} line{i % 5}" for i in range(300))
    passage = "quartz lanterns illuminate forgotten harbours beneath crimson winter skies"
    docs = [(1, f"{filler} {passage}. {filler}"), (2, filler), (3, "short text of something else")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, "absent zebra umbrella notebook")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.qid: (r.hit, r.covered) for r in registry_graph.passages(spark, str(tmp_path)).collect()}
    assert got == {7: (1.0, 1.0), 8: (0.0, 0.0)}
