import itertools
import random
import re

import numpy as np

from corpusflow.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = t.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, x in enumerate(g) if g.count(x) > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def texts():
    rng = random.Random(1)
    made = [None, "", "\n\n", " a b\x1cc \xa0d", "x\ny\nx\nx \n\n \n", "a b c d e a b c d e", "a " * 30, "a b c d e f g a b c d e f h"]
    return made + ["".join(rng.choices(["a ", "b ", "é ", "#", "\n", "\t", "\r", "| ", "a\n"], k=rng.randrange(80))) for _ in range(200)]


def test_counts():
    for t in texts():
        assert Q.counts((t or "").encode(), len(t or "")) == brute(t), repr(t)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        f = Q.Field(rng.normal(size=(len(Q.FEATURES), 2)), rng.normal(size=(2, 2)))
        x = rng.random((n, len(Q.FEATURES)))
        e = x @ f.weights
        score = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(f.pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: B905, B023, E731
        assert abs(score(f.viterbi(x)) - max(map(score, itertools.product((0, 1), repeat=n)))) < 1e-9


def test_field_learns_lines():
    f = Q.fit(Q.generated())
    rows = Q.generated(200, seed=99)
    right = sum((np.asarray(f.viterbi(x)) == y).sum() for x, y in rows)
    assert right / sum(len(y) for _, y in rows) > 0.93


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    f = Q.train(docs, labels.filter("doc_id % 2 = 0"))
    got = Q.judge(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), f).select("quality", "kept", "base_failed").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1, (sum(good), len(good), sum(bad), len(bad))


def test_operator(spark):
    made = texts()
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(made)], "doc_id long, text string, kept boolean")
    out = Q.judge(df, Q.train())
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("kept") == 1
    for r in out.collect():
        n, _, _, _, rep = brute(made[r.doc_id])
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and not (r.base_failed and r.kept)
    assert Q.judge(df.filter("false"), Q.train()).count() == 0
    assert len(Q.train(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).pairs) == 2


def test_query(spark):
    """The registered query over its whole table: base columns by brute force, the verdict by the field and Viterbi."""
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    f = Q.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    got = Q.op5_quality(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        n, chars, symbols, dup, rep = brute(text[r.doc_id])
        failed = n < 10 or 100 * rep > 20 * n
        lines = [x for x in text[r.doc_id].encode().split(b"\n") if x.strip()]
        y = f.viterbi(np.asarray(Q.text_features(lines), float))
        sizes = [len(x.strip()) for x in lines]
        share = sum(s for s, k in zip(sizes, y, strict=True) if k) / sum(sizes)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, rep, failed)
        assert r.kept == (not failed and share >= Q.SHARE) and abs(r.content_share - share) < 1e-12


def test_query_of_an_empty_table_and_long_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert Q.op5_quality(spark, str(tmp_path)).count() == 0
    long = "\n".join(f"Line {i} of a long text has its own words here, number {i * 7}." for i in range(30_000))
    r = Q.judge(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"), Q.train()).collect()
    assert len(r) == 2 and r[0].n_words == len(WORD.findall(long)) and len(r[0].line_labels) == 30_000


def test_every_line_teaches(spark):
    """Lines behind the 32nd of a document count in the fit."""
    text = "\n".join(["An ordinary sentence stands here for once."] * 40 + ["### $$$ ### $$$ ### $$$ %%%"] * 400)
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    late = np.asarray(Q.text_features([b"### $$$ ### $$$ ### $$$ %%%"] * 5))
    assert sum(Q.train(docs, labels).viterbi(late)) == 5 and sum(Q.train().viterbi(late)) == 0
