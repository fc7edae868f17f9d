import json

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import datasets, files, snapshot
from corpusflow.streaming import index as live
from corpusflow.streaming import limiter


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8-sig")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\x00 broken")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c.txt").write_text("hidden")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.markdown").write_text("deep")
    (tmp_path / "e.bin").write_text("other")
    got = {r.source.rsplit("/", 1)[1]: r for r in files.documents(spark, str(tmp_path), detect=lambda b: None).collect()}
    assert set(got) == {"a.txt", "b.md", "d.markdown"} and got["a.txt"].text == "héllo" and got["b.md"].status == "error"
    assert files.decode(b"\xe9", "latin-1") == "é" and files.decode(b"\xe9", detect=lambda b: ("latin-1", 5.0, 90.0)) == "é"
    with pytest.raises(UnicodeDecodeError):
        files.decode(b"\xe9", detect=lambda b: ("latin-1", 50.0, 90.0))
    assert files.merged_pages([(0, "a"), (3, "b")]) == [(0, "a"), (3, "b")] and files.merged_pages([(0, "a" * 4000), (1, "b")])[0][0] is None


def test_code(spark, tmp_path):
    for name in ("m.py", "tests/test_m.py", "pkg/n.py", "docs/x.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("class A:\n    pass\n")
    assert sorted(r.doc_id for r in files.code_files(spark, str(tmp_path)).collect()) == ["m.py", "pkg/n.py"]


def test_json_and_beir(spark, tmp_path):
    rec = spark.createDataFrame([(0, ["a", " ", "b"], "q0", "x"), (1, ["c"], None, None), (2, ["d"], "", "")], "n long, documents array<string>, question string, answer string")
    got = sorted((r.source, r.text) for r in datasets.json_documents(rec, "/f.json", limit=2).collect())
    assert got == [("/f.json#0", "a"), ("/f.json#1", "b"), ("/f.json#2", "c")]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "ask"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nbroken\n")
    c, q, r = datasets.beir(spark, str(tmp_path))
    assert {x.doc_id: x.text for x in c.collect()} == {"d1": "T x", "d2": "y"} and q.count() == 1 and [tuple(x) for x in r.collect()] == [("q1", "d1")]


def test_nested(spark, tmp_path):
    paper = {"id": "p", "title": "T", "abstract": "A", "full_text": {"section_name": ["S", ""], "paragraphs": [["one", "", "two"], ["three"]]}, "qas": {"question": ["why", "how"], "question_id": ["x1", ""], "answers": [{"answer": [{"evidence": ["e1"], "highlighted_evidence": ["e1", "e2"]}]}, {"answer": [{"evidence": [], "highlighted_evidence": []}]}]}}
    (tmp_path / "p.json").write_text(json.dumps(paper))
    rows = spark.read.json(str(tmp_path / "p.json"))
    corpus, asked = datasets.papers(rows)
    assert corpus.first().text == "T A\n\n## S\none\ntwo\n\nthree" and sorted(r.qid for r in asked.collect()) == ["p-q1", "x1"]
    assert sorted((r.qid, r.gold) for r in datasets.paper_evidence(rows).collect()) == [("x1", "e1"), ("x1", "e2")]
    article = {"title": "Art", "paragraphs": [{"context": "c0", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a"}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(article))
    c, q = datasets.squad(spark.read.json(str(tmp_path / "s.json")))
    assert c.first().doc_id == "Art_0" and q.first().answers == ["a"]
    long = spark.createDataFrame([("a", "x" * 50_000, "y" * 90), ("b", "short", "y" * 90)], "id string, article string, abstract string")
    c, q = datasets.long_papers(long)
    assert [len(r.text) for r in c.collect()] == [40_000] and q.first().qid == "a-abs"
    inst = spark.createDataFrame([("i1", "r", "--- a/x.py\n", '["t1"]'), ("i2", "r", "--- a/y.py\n", "[]"), ("i3", "r", "", "[]")], "instance_id string, repo string, patch string, FAIL_TO_PASS string")
    assert [(r.instance_id, r.tests) for r in datasets.patch_instances(inst, per_repo=1).collect()] == [("i1", ["t1"])]


def test_result_files(spark, tmp_path):
    for name, body in (("a.json", {"task_name": "A", "scores": {"test": [{"main_score": 0.5}], "dev": [{"main_score": 0.1}]}}), ("b.json", {"task_name": "B", "scores": {"dev": [{"main_score": 0.2}]}}), ("c.json", {"task_name": "C", "scores": {}})):
        (tmp_path / name).write_text(json.dumps(body))
    got = sorted((r.task, r.split, r.main_score, r.path) for r in datasets.result_files(spark, str(tmp_path), ["A", "B", "C"]).collect())
    assert got == [("A", "test", 0.5, "a.json"), ("B", "dev", 0.2, "b.json")]


def test_classify_and_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "source string, sha256 string")
    new = spark.createDataFrame([("a", "1", "ok"), ("b", "2", "ok"), ("c", "2", "error"), ("e", "5", "ok"), ("f", "6", "error")], "source string, sha256 string, status string")
    got = {r.source: (r.state, r.sha256) for r in snapshot.classify(old, new).collect()}
    assert got == {"a": ("same", "1"), "b": ("changed", "2"), "c": ("failed", "1"), "d": ("deleted", None), "e": ("new", "5"), "f": ("failed", None)}
    with pytest.raises(ValueError):
        snapshot.refuse_changed(snapshot.classify(old, new))
    assert snapshot.same_manifest(old, old) and not snapshot.same_manifest(old, new)
    chunks = spark.createDataFrame([(1, "a", "x")], "id long, source string, text string")
    with pytest.raises(ValueError):
        snapshot.merge(chunks, chunks, chunks.limit(0))


def test_store(spark, tmp_path):
    store = snapshot.Store(spark, str(tmp_path / "idx"))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = live.upsert(store, docs([(1, "a", "One text."), (2, "b", "Other text."), (2, "b", "Other text.")]))
    second = live.upsert(store, docs([(1, "a", "Changed text.")]))
    assert sorted(r.text for r in store.load()["chunks"].collect()) == ["Changed text.", "Other text."] and store.current() == {"build": second, "previous": first}
    with pytest.raises(snapshot.Conflict):
        store.publish({"chunks": store.load()["chunks"]}, {}, expected=first)
    with pytest.raises(ValueError):
        store.load({"encoder": "x"})
    with pytest.raises(ValueError):
        store.publish({"chunks": docs([]).withColumn("id", F.lit("x"))}, {})
    bad = spark.createDataFrame([("x", "gone")], "id string, basin_id string")
    assert snapshot.problems({"chunks": bad}) == ["basins without their attractor"]
    assert snapshot.problems({"chunks": bad.withColumn("basin_id", F.lit("x")), "edges": spark.createDataFrame([("x", "y")], "src string, dst string")}) == ["edges without their chunks"]
    damaged = next((tmp_path / "idx" / "builds" / second / "chunks").glob("*.parquet"))
    damaged.with_name("extra.parquet").write_bytes(damaged.read_bytes())
    with pytest.raises(ValueError):
        store.load()


def test_stream_follows(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", "Stream text.")], "doc_id long, source string, text string").write.parquet(str(src))
    store = snapshot.Store(spark, str(tmp_path / "idx"))
    stream = spark.readStream.schema("doc_id long, source string, text string").parquet(str(src))
    q = live.follow(stream, store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.text for r in store.load()["chunks"].collect()] == ["Stream text."]


def limited(rows, limit, window):
    passed, out = {}, []
    for i, (k, t) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        mine = passed.setdefault(k, [])
        ok = len([x for x in mine if x > t - window]) < limit
        mine += [t] * ok
        out.append((i, ok))
    return sorted(out)


def test_limiter(spark, tmp_path):
    rows = [(i % 3, float((i * 7) % 50)) for i in range(200)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "event_id long, user_id long, at double")
    want = limited(rows, 4, 10.0)
    assert sorted((r.event_id, r.allowed) for r in limiter.limited(df, ["user_id"], limit=4, window=10.0, order="event_id").collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = limiter.limited_stream(stream, "user_id", limit=4, window=10.0).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_id, r.allowed) for r in spark.table("limits").collect()) == want


def test_small_things(spark):
    s = spark.createDataFrame([("T", "map", 0.25), ("T", "nauc_x", 0.9), ("T", "ndcg_at_10", 0.5)], "task string, metric string, value double")
    out = snapshot.leaderboard(s)
    assert out.index("ndcg_at_10") < out.index("map") and "nauc" not in out and "50.0" in out
    tasks = spark.createDataFrame([("a",), ("b",)], "id string")
    done = spark.createDataFrame([("a", "s", "p"), ("b", "other", "p")], "id string, subset_id string, protocol_id string")
    assert [r.id for r in snapshot.unfinished(tasks, done, "s", "p").collect()] == ["b"]
    basins = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f")], "basin_id long, fingerprint string")
    states = spark.createDataFrame([(1, "f", "done", 1, 0.0), (2, "f", "failed", 1, 5.0), (3, "old", "done", 1, 0.0)], "basin_id long, fingerprint string, status string, attempts int, retry_after double")
    assert sorted(r.basin_id for r in snapshot.pending_summaries(basins, states, 9.0).collect()) == [2, 3]
    assert snapshot.retry_delay(1) == 2.0 and snapshot.retry_delay(10) == 60.0
    corpus, asked = datasets.mini_corpus(spark)
    assert corpus.count() == 8 and asked.count() == 5


def test_pointer_and_lock(spark, tmp_path):
    """The pointer is replaced in one step; a lock that a dead writer left goes after its time, a fresh one stays."""
    import os
    import time

    import pytest

    store = snapshot.Store(spark, str(tmp_path / "ix"))
    for n in range(3):
        store._write("current.json", {"build": str(n)})
        assert store.current() == {"build": str(n)}
    assert [f for f in os.listdir(tmp_path / "ix") if f.startswith(".current.json.") and not f.endswith(".crc")] == []
    held = store.lock()
    with pytest.raises(snapshot.Conflict):
        store.lock(wait=0.5)
    os.utime(held, (time.time() - 9000,) * 2)
    assert store.lock(wait=0.5, stale=3600) == held


def test_digest_of_many_rows(spark):
    """Longer prefixes for more rows: any order and split gives the same, one changed row another."""
    of = lambda df: snapshot.digest_of(df, ["id", "x"], place=1).first()
    a = of(spark.range(20_000).withColumn("x", F.col("id") % 7))
    b = of(spark.range(19_999, -1, -1, 3).withColumn("x", F.col("id") % 7))
    c = of(spark.range(20_000).withColumn("x", F.when(F.col("id") == 77, 9).otherwise(F.col("id") % 7)))
    assert a == b and a.digest != c.digest and a.rows == 20_000
