import zlib

import numpy as np

from corpusflow.llm import gbt
from corpusflow.llm import toxicity as X


def test_isotonic():
    knots, levels = gbt.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(levels) >= 0).all() and levels[0] < 0.1 < 0.9 < levels[-1]


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gbt.fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).shape == (2,)


def test_features():
    lex = {b"idiot": 3.0}
    f = dict(zip(X.FEATURES, X.features("YOU are an 1d1ot, idiot!!", lex), strict=True))
    assert f["hits"] == 1 and f["near_you"] > 0 and f["undone"] > 0 and f["marks"] > 0
    assert X.features(None, lex) == X.features("", lex) and len(X.features("x", {})) == len(X.FEATURES)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in X.op4_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(labels[k], r.predicted, r.score) for k, r in got.items() if r.held_out and k in labels]
    hit = sum(a and b for a, b, _ in held)
    assert hit / sum(b for _, b, _ in held) > 0.9 and hit / sum(a for a, _, _ in held) > 0.88, (hit, len(held), sum(b for _, b, _ in held), sum(a for a, _, _ in held))


def test_no_caps_and_unicode_case():
    f = lambda t, lex: dict(zip(X.FEATURES, X.features(t, lex), strict=True))
    words = {f"w{chr(97 + i)}{chr(97 + j)}".encode(): 2.0 for i in range(10) for j in range(10)} | {b"x" * 60: 1.0, "élan".encode(): 1.0}
    got = f(" ".join(w.decode() for w in words) + " ÉLAN ÀÉ", words)
    assert got["hits"] == 103 and got["distinct"] == 102 and f("ÀÉÎ", {})["capitals"] == 1.0 and f("àéî", {})["capitals"] == 0.0
    long = "clean words only " * 200_000 + "idiot"
    assert f(long, {b"idiot": 3.0})["hits"] == 1


def test_no_fold_teaches_its_own_lexicon(spark):
    rows = [(i, f"plain text number {i}" if i % 2 else f"you awfulword{'h' if i % 3 else 'k'} {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int")
    sample = X.training_rows(docs, labels)
    taught = sample.collect()
    lexicons = X.learn_lexicons(sample)
    assert len(lexicons) == X.FOLDS + 1 and len({r.fold for r in taught}) == X.FOLDS
    for f, lexicon in enumerate(lexicons):
        part = [r for r in taught if r.fold != f]
        toxic, clean = sum(r.label for r in part), sum(1 - r.label for r in part)
        for w, ratio in lexicon.items():
            t, c = (sum(w in X.words_of(r.text) for r in part if r.label == y) for y in (1, 0))
            assert abs(ratio - np.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))) < 1e-9 and t >= 3
    twice = X.classify(docs.union(docs.limit(3)), X.train(docs, labels)).filter("doc_id < 3").collect()
    assert len(twice) == 6 and all(len({r.score for r in twice if r.doc_id == i}) == 1 for i in range(3))


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (2, "x", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.classify(docs, X.train(docs, none))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and {r.score for r in out.collect()} == {0.0} and out.count() == 4
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in X.classify(docs, X.train(docs, one)).collect()} <= {0.0, 1.0}
    assert X.classify(docs.filter("false"), X.train(docs, one)).count() == 0
