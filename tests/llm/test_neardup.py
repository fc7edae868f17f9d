import random
import re

import numpy as np

from corpusflow.llm import neardup as N

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return sorted(((d, len(s), None if d is None else top(d), d is None or d == top(d)) for d, s in sets), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, id int").repartition(3)
    return sorted(map(tuple, N.near_duplicates(df).collect()), key=str)


def test_hashes_match_the_definition():
    for t in ["", "  \n", "One two", "a b c d e f", "A b  C\td e\x0bF a b c d e f", "é É x\xa0y z", "x " * 50]:
        assert len(N.shingle_hashes(t.encode())) == len(shingles(t))
    assert (N.shingle_hashes(b"A b C d e") == N.shingle_hashes(b"a B\n c  d E")).all()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        got = []
        for _ in range(60):
            n = 400
            both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
            own = [rng.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
            a, b = (N.signature(np.concatenate([both, o])) for o in own)
            got.append((a == b).mean())
        assert abs(np.mean(got) - share) < 0.025


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "HOT", 5)
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for n, k, e in [(200, 12, 2), (200, 25, 3), (150, 20, 4), (90, 6, 1), (300, 30, 8)]:
        base = text(n)
        texts += [" ".join(base)] + family(rng, base, k, e)
    chain = text(240)  # neighbours are similar, ends are not
    for i in range(12):
        texts.append(" ".join(chain[i * 6 : i * 6 + 170]))
    texts += [" ".join(text(60)) for _ in range(30)] + ["same words here again and again"] * 40 + ["Short one", "short ONE", "other", "", None, " \n "]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(None, "short one"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_very_long_texts(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = [x if i % 200 else f"e{i}" for i, x in enumerate(base)]
    rows = [(7, " ".join(base)), (3, " ".join(near)), (5, " ".join(base[::-1])), (9, " ".join(base[:40_000]))]
    assert run(spark, rows) == brute(rows) and len({r[2] for r in brute(rows)}) == 3


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f"), (4, "z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, N.op3_neardup(spark, d).collect()), key=str) == brute(rows)
