import hashlib
import random
import re

from corpusflow.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=8):
    wins = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            k = min(size, len(w))
            for s in range(len(w) - k + 1):
                wins.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if x := wins.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    got |= x
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(got) >= 2))
    return sorted(out, key=str)


def run(spark, docs, items):
    from pyspark.sql import functions as F

    a = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.contamination(a, b).select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), "contaminated")
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "and"] * 4 + [f"w{i}" for i in range(25)] + ["Été", "ñandú"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([20, 12, 8, 5, 3, 1, 30, 9])]
    items += [(8, None), (9, " .. "), (None, "the of and w1 w2 w3 w4 w5"), (10, items[0][1]), (0, "the the the the the the the the the the")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(40)]
    for j in range(30):
        w = (items[rng.randrange(8)][1] + " " + items[rng.randrange(8)][1]).split()
        s = rng.randrange(len(w))
        docs.append((100 + j, " ".join(rng.choices(vocabulary, k=5)) + "!  " + ", ".join(w[s : s + rng.randrange(4, 25)]).upper().replace("É", "é") + "."))
    docs += [(1, None), (2, ""), (None, items[2][1]), (3, items[6][1]), (3, items[6][1]), (4, "the " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    assert run(spark, [], [(1, "a b")]) == []


def test_proximity(spark):
    a = spark.createDataFrame([(1, "one two x three four"), (2, "four three two one"), (3, "one two y y y y y y y y y three four")], "doc_id long, text string")
    terms = D.test_terms(spark.createDataFrame([(7, "one two three four")], "item_id long, text string"))
    index = D.build_index(a, terms)
    ids = {r.row: r.doc_id for r in index.filter("term = ''").collect()}
    assert {ids[r.row] for r in D.proximity_matches(index, terms, slop=1).collect()} == {1}
    assert {ids[r.row] for r in D.proximity_matches(index, terms, slop=6).collect()} == {1, 2}
    assert D.phrase_matches(index, terms).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = sorted(map(tuple, D.op7_decontaminate(spark, d).collect()), key=str)
    assert got == brute(docs, items) and any(r[2] for r in got)
