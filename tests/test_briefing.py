import pytest
from pyspark.sql import functions as F

from corpusflow.operators import briefing as B


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("Summary", "global"), ("overview?", "global"), ("what is the main theme of this book", "global"), ("explain the nearby context", "local"), ("in this section what happens", "local"),
        ("cell division", "hybrid"), ("how does the enzyme bind to the receptor in summary of several unrelated biological experiments", "hybrid"), ("compare the two articles", "global"),
        ("核心思想", "global"), ("Zusammenfassung dieses Textes", "global"), ("a plain question about harbour tides", "hybrid"), ("", "hybrid"),
    ],
)
def test_route(spark, query, want):
    assert spark.createDataFrame([(query,)], "t string").select(B.route(F.col("t"))).first()[0] == want


def test_centroids(spark):
    ex = spark.createDataFrame([("global", [1.0, 0.0, 0.0]), ("hybrid", [0.0, 1.0, 0.0]), ("local", [0.0, 0.0, 1.0])], "route string, vector array<double>")
    q = spark.createDataFrame([(1, "four words are here", [1.0, 0.1, 0.0]), (2, "four words are here", [0.0, 1.0, 0.9]), (3, "four words are here", [0.0, 0.1, 1.0]), (4, "two words", [1.0, 0.0, 0.0])], "qid long, text string, vector array<double>")
    assert {r.qid: r.route for r in B.route_by_centroids(q, ex).collect()} == {1: "global", 2: "hybrid", 3: "local", 4: "hybrid"}


def chunks(spark):
    rows = [(f"c{i}", "s", i, f"text {i}" if i != 3 else "text 1", [max(0, i - 2), min(5, i + 1)] if i < 4 else None, "c0" if i < 3 else "c3", i % 3) for i in range(6)]
    return spark.createDataFrame(rows, "id string, source string, chunk_index int, text string, parent_span array<int>, basin_id string, hops int")


def test_windows(spark):
    hits = spark.createDataFrame([("q", "c2"), ("q", "c4")], "qid string, id string")
    got = {r.id: r.context for r in B.parent_windows(hits, chunks(spark)).collect()}
    assert got == {"c2": "text 2\n\ntext 0\n\ntext 1", "c4": "text 4\n\ntext 1\n\ntext 5"}


def test_packet(spark):
    seeds = spark.createDataFrame([("q", "c1", 1), ("q", "c4", 2), ("q", "c0", 3)], "qid string, id string, rank int")
    labels = spark.createDataFrame([("c0", "first"), ("c3", "second")], "basin_id string, label string")
    p = B.packets(seeds, chunks(spark), 2, labels=labels).first()
    # c0 is a seed beyond k: it never comes back as context
    assert list(p.ids) == ["c1", "c4", "c2", "c3"] and len(p.hubs) == 2 and len(p.neighbors) == 2 and list(p.satellites) == ["first", "second"]
    docs = B.as_documents(spark.createDataFrame([p]), chunks(spark), 3).orderBy("rank").collect()
    assert [(r.id, r.role) for r in docs] == [("c1", "seed"), ("c4", "seed"), ("c2", "context")]


def test_context_budget():
    head = "[Hubs]\n" + "aa" * 10 + "\n\n[Neighbors]\ncc"  # 39 visible characters: 20 tokens; with the satellite 53: 27
    hubs = ["aa" * 10, "bb" * 100]
    assert B.as_context(hubs, ["cc"], ["dd"], budget=30) == head + "\n\n[Satellites]\ndd"
    assert B.as_context(hubs, ["cc"], ["dd"], budget=26) == head
    assert B.as_context([], [], []) == ""
    p = {"hubs": ["one <b>"], "neighbors": ["two"], "satellites": ["sat"], "ids": ["i1", "i2"]}
    told = B.budgeted_prompt(p, "why?", "sys")
    assert "[ref:i1] one &lt;b&gt;" in told and "[ref:i2] two" in told and told.index("[Hubs]") < told.index("[Satellites]")
    with pytest.raises(ValueError):
        B.budgeted_prompt(p, "why? " * 9000, "sys")


def test_citations(spark):
    df = spark.createDataFrame([("see [ref:a] and [ref:b]",), ("no refs",), ("[ref:z]",)], "t string")
    assert [r[0] for r in df.select(B.citations_hold(F.col("t"), F.array(F.lit("a"), F.lit("b")))).collect()] == [True, True, False]


def test_rerank(spark):
    hits = spark.createDataFrame([("q", "a", 1, "x"), ("q", "b", 2, "x"), ("q", "c", 3, "x")], "qid string, id string, rank int, query string")
    texts = spark.createDataFrame([("a", "1"), ("b", "33"), ("c", "33")], "id string, text string")
    got = B.rerank(hits, texts, lambda q, t: [float(len(x)) for x in t], 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "c"]
