import hashlib
import struct

import corpus_pipeline as C
from corpusflow.llm import bpe, common, secrets, toxicity
from tests.llm import test_decontaminate, test_neardup, test_secrets


def test_pipeline_against_its_parts(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    left = {k: r.text for k, r in rows.items() if model.score([r.text])[0] < 0.5}
    assert 0 < len(left) < len(rows)
    left = {k: left[k] for k, _, _, kept in test_neardup.brute(list(left.items())) if kept}
    clean = {r[0] for r in test_decontaminate.brute(list(left.items()), items) if r[3] == 0}
    want = set()
    enc = bpe.encoder(common.tokenizer_path("word_bpe_49k.json"))
    for k in clean:
        t, at, out = left[k], 0, ""
        for a, e, kind in test_secrets.brute(t):
            if a >= at:
                out += t[at:a] + f"[{kind}]"
            at = max(at, e)
        ids = enc.encode(out + t[at:])
        want.add((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()))
    assert set(map(tuple, C.run(spark, d).collect())) == want


def test_odd_documents(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text", None, None, None), (5, 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" x', "en", "s", 50)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, spans string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns, name
        at = common.materialize(at, name)
    got = at.collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.doc_id == 5} == {len("[assign]\" x")}, got
    assert secrets.KINDS[0] == "assign" and C.run(spark, d).count() == 5
    docs.filter("false").write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert C.run(spark, d).count() == 0
