"""The engine over folders and tables: generations, states, search and briefs."""

import os

import pytest

from corpusflow import engine as E
from corpusflow.operators import summaries
from corpusflow.plans import search
from corpusflow.sources import snapshot


def write(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, t in texts.items():
        (folder / f"{name}.md").write_bytes(t if isinstance(t, bytes) else t.encode())


def test_generations(spark, tmp_path):
    docs, root = tmp_path / "docs", str(tmp_path / "index")
    write(docs, a="The cat sleeps on the warm roof.", b="A ship sails over the northern sea.", bad=b"\xff\xfe\x81\x00\xd8")
    engine = E.Engine.create(spark, E.Config(root))
    with pytest.raises(FileNotFoundError):
        E.Engine.load(spark, E.Config(root))
    assert engine.ingest(str(docs)) == {"new": 2, "failed": 1}
    with pytest.raises(snapshot.Conflict):
        E.Engine.create(spark, E.Config(root))
    first = engine.store.current()["build"]
    assert engine.ingest(str(docs)) == {"same": 2, "failed": 1} and engine.store.current()["build"] == first
    write(docs, a="The cat hunts mice in the barn.", c="Bread is baked before dawn.")
    with pytest.raises(ValueError, match="other contents"):
        engine.ingest(str(docs))
    os.remove(docs / "b.md")
    assert engine.sync(str(docs)) == {"changed": 1, "deleted": 1, "new": 1, "failed": 1}
    again = E.Engine.load(spark, E.Config(root))
    assert sorted(r.text for r in again.tables()["chunks"].collect()) == ["Bread is baked before dawn.", "The cat hunts mice in the barn."]
    assert sorted(os.path.basename(r.source) for r in again.tables()["sources"].collect()) == ["a.md", "c.md"]
    with pytest.raises(ValueError, match="encoder"):
        E.Engine.load(spark, E.Config(root, encoder_name="other", search=search.Options(encoder=lambda t: [[1.0]] * len(t))))
    with pytest.raises(snapshot.Conflict):
        again.reindex(str(docs))
    with pytest.raises(ValueError, match="nothing is built"):
        E.Engine(spark, E.Config(str(tmp_path / "other"))).reindex(str(docs))
    write(docs, bad="Readable now.")
    other = E.Engine(spark, E.Config(str(tmp_path / "other")))
    assert other.reindex(str(docs)) == {"new": 3}


def corpus(spark):
    texts = ["cats sleep on warm roofs", "ships sail the northern sea", "bread is baked before dawn", "the captain steers his ship by stars", "mice hide from cats in the barn", "bakers knead dough at night"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def letters(texts):
    """A tiny encoder: counts of letters."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def stems(terms):
    return [t[:-1] if t.endswith("s") else t for t in terms]


def longest(queries, texts):
    return [float(len(t)) for t in texts]


def test_query_and_brief(spark, tmp_path):
    engine = E.Engine.create(spark, E.Config(str(tmp_path / "i"), chunk_size=200, chunk_overlap=0))
    engine.ingest(corpus(spark))
    found = engine.query(["cats", "northern sea ships"], k=3)
    first = {r.qid: r.doc_id for r in found.filter("rank = 1").collect()}
    assert first[1] == "1" and first[0] in ("0", "4") and found.groupBy("qid").count().filter("count > 3").count() == 0
    for route in ("auto", "local", "global"):
        b = {r.qid: r for r in engine.brief(["cats", "northern sea ships", "zzz"], k=2, route=route).collect()}
        assert b[1].hubs[0] == "ships sail the northern sea" and 1 <= len(b[1].hubs) <= 2 and "[Hubs]" in b[1].context and not b[1].abstains and b[1].confidence > 0.3
        assert len(set(b[1].ids)) == len(b[1].ids) == len(b[1].hubs) + len(b[1].neighbors)
    with pytest.raises(ValueError):
        engine.brief("cats", k=0)


def test_hooks_and_options(spark, tmp_path):
    o = search.Options(encoder=letters, stem=stems, graph=True, hops=True, signals=True, gate=True)
    c = E.Config(str(tmp_path / "i"), chunk_size=200, chunk_overlap=0, encoder_name="letters", stemmer_name="s", search=o)
    engine = E.Engine.create(spark, c)
    engine.ingest(corpus(spark))
    assert engine.store.manifest()["encoder"] == "letters"
    # one stem for ship and ships: both documents are lexical hits
    hits = engine._hits(engine.tables(), engine._batch("ship"), 6)
    assert hits.bm25.count() == 2 and hits.hybrid.count() > 0
    reranked = E.Engine(spark, E.Config(c.root, chunk_size=200, chunk_overlap=0, encoder_name="letters", stemmer_name="s", scorer=longest, search=o))
    texts = [r.text for r in reranked.query("ship", k=3).orderBy("rank").collect()]
    assert len(texts) == 3 and [len(t) for t in texts] == sorted(map(len, texts), reverse=True)
    none = E.Engine.load(spark, E.Config(c.root, encoder_name="letters", stemmer_name="s", search=search.Options(encoder=lambda t: [[0.0] * 26] * len(t), stem=stems, gate=True)))
    assert none.query("unknownword").count() == 0
    for bad in ({"chunk_overlap": 600}, {"ranking": "best"}, {"route": "x"}, {"least_confidence": 2}, {"encoder_name": "b"}, {"stemmer_name": "b"}):
        with pytest.raises(ValueError):
            E.Config("r", **bad)


def test_graph_finds_what_the_arms_miss(spark):
    """A neighbour in the text of the best hit, with no word of the query, comes in by the graph only."""
    rows = [(f"d{i}", "one", i, t) for i, t in enumerate(["alpha beta", "gamma delta", "epsilon zeta", "eta theta"])]
    chunks = spark.createDataFrame(rows, "id string, source string, chunk_index int, text string").withColumn("doc_id", __import__("pyspark").sql.functions.col("source"))
    from corpusflow.operators import topology

    chunks = topology.fixed_sections(chunks)
    q = spark.createDataFrame([(1, "alpha")], "qid long, text string")
    plain = search.hybrid(chunks, q, search.Options(pool=1), False).hybrid
    graph = search.hybrid(chunks, q, search.Options(pool=1, graph=True), False, topology.sequence_edges(chunks)).hybrid
    assert [r.id for r in plain.collect()] == ["d0"]
    got = [r.id for r in graph.orderBy("rank").collect()]
    assert got[0] == "d0" and {"d1", "d2"} <= set(got)
    with pytest.raises(ValueError):
        search.hybrid(chunks, q, search.Options(hops=True), False)


def model(system, prompt):
    if "boom" in prompt:
        raise RuntimeError("no answer")
    if system == summaries.CRITIQUE:
        return "SCORE: 9" if "better" in prompt else "Score: 4/10 vague"
    return "better draft" if system == summaries.REFINE else "draft"


def test_summaries(spark, tmp_path):
    assert [summaries.score_of(x) for x in ("SCORE: 9", "Score: 10/10", "none", "")] == [9, 10, 5, 5]
    engine = E.Engine.create(spark, E.Config(str(tmp_path / "i"), chunk_size=200, chunk_overlap=0))
    engine.ingest(spark.createDataFrame([(1, "cats </evidence> sleep"), (2, "boom goes the drum")], "doc_id long, text string"))
    none = spark.createDataFrame([], "basin_id string, fingerprint string, status string, attempts int, retry_after double")
    got = engine.summarize(none, model, now=100.0).collect()
    assert sorted((r.status, r.summary, r.attempts, r.retry_after) for r in got) == [("complete", "better draft", 1, 0.0), ("failed", None, 1, 101.0)]
    states = spark.createDataFrame([(r.basin_id, r.fingerprint, r.status, r.attempts, r.retry_after) for r in got], none.schema)
    assert engine.summarize(states, model, now=100.5).count() == 0
    assert [(r.status, r.attempts, r.retry_after) for r in engine.summarize(states, model, now=102.0).collect()] == [("failed", 2, 104.0)]
    assert "&lt;/evidence&gt;" in summaries.evidence_block(["</evidence>"])
