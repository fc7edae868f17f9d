import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusflow.functions.lexicon import ENTITY_PARTS, ENTITY_STOP_WORDS
from corpusflow.operators import dense, topology, walk


def test_attractors(spark):
    rows = [("x", "y"), ("y", "x"), ("tail", "x"), ("sink", None), ("orphan", "absent")]
    got = {r.node: (r.attractor, r.hops) for r in topology.attractors(spark.createDataFrame(rows, "node string, next string")).collect()}
    assert got == {"x": ("x", 0), "y": ("x", 1), "tail": ("x", 1), "sink": ("sink", 0), "orphan": ("absent", 1), "absent": ("absent", 0)}


def test_long_chain_and_circle(spark):
    n = 150
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)]
    got = {r.node: (r.attractor, r.hops) for r in topology.attractors(spark.createDataFrame(rows, "node long, next long")).collect()}
    assert all(got[i] == (0, i) for i in range(n)) and all(got[1000 + i] == (1000, (7 - i) % 7) for i in range(7))


def test_adaptive_sections(spark):
    v = {"0": [1.0, 0.0], "1": [0.0, 1.0], "z": [0.0, 0.0]}
    seq = ["0", "0", "0", "1", "1", "1", "z"]
    rows = [(i, "s", i, v[k]) for i, k in enumerate(seq)]
    out = topology.adaptive_sections(spark.createDataFrame(rows, "id long, source string, chunk_index int, vector array<double>"), threshold=0.2, longest=5, shortest=3)
    assert sorted({r.basin_id for r in out.collect()}) == [0, 3, 6]


def test_cohesion_of_single_and_split(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, basin_id long")
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert {r.basin_id: r.cohesion for r in topology.cohesion(c, e).collect()} == {1: 0.67, 3: 1.0}


def greedy(pairs, cap):
    out, used = set(), {}
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            out.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return out


def test_virtual_edges_are_the_greedy_choice(spark):
    rng = np.random.default_rng(2)
    pairs = [(a, b, round(float(rng.integers(85, 100)) / 100, 2)) for a in range(18) for b in range(a + 1, 18) if rng.random() < 0.7]
    got = topology.virtual_edges(spark.createDataFrame(pairs, "src long, dst long, sim double"), cap=3)
    assert {(r.src, r.dst) for r in got.collect()} == greedy(pairs, 3)


def test_similar_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 6) >= 0.6}
    was, dense.PAIR_BLOCK = dense.PAIR_BLOCK, 16
    try:
        assert {(r.src, r.dst) for r in dense.similar_pairs(df, 0.6).collect()} == want
    finally:
        dense.PAIR_BLOCK = was


def test_similar_pairs_of_a_large_group(spark):
    n = 300
    made = [(i, [1.0, 0.0]) for i in range(n)] + [(n, [0.0, 1.0])]
    df = spark.createDataFrame(made, "id long, vector array<double>")
    got = dense.similar_pairs(df, 0.6).collect()
    assert len(got) == n * (n - 1) // 2 and {(r.src, r.dst) for r in got} == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_exact_and_approximate(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = df.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    exact = dense.exact_top_k(df, q, 5, floor=-2.0)
    for r in exact.collect():
        order = sorted(range(400), key=lambda i: (-round(float(v[i] @ v[r.qid]), 6), i))
        assert order[r["rank"] - 1] == r.id
    miss = dense.ann_misses(exact, dense.approximate_top_k(df, q, 5, cells=8, probes=8)).agg(F.sum("missed")).first()[0]
    assert miss == 0
    low = dense.exact_top_k(df.filter("id = 7"), spark.createDataFrame([(1, (-v[7]).tolist())], "qid long, vector array<double>"), 5)
    assert low.count() == 1  # the first stays, however low


def pagerank(nodes, edges, seeds, alpha=0.5, rounds=15, tol=1e-5):
    out = {n: {} for n in nodes}
    for a, b, w in edges:
        out[a][b] = out[b][a] = w
    total = sum(seeds.values())
    home = {n: seeds.get(n, 0) / total for n in nodes}
    x = dict(home)
    for _ in range(rounds):
        lost = sum(x[n] for n in nodes if not out[n])
        y = {n: alpha * lost * home[n] + (1 - alpha) * home[n] for n in nodes}
        for a in nodes:
            for b, w in out[a].items():
                y[b] += alpha * x[a] * w / sum(out[a].values())
        moved = sum(abs(y[n] - x[n]) for n in nodes)
        x = y
        if moved < tol:
            break
    top = max(x.values())
    return {n: x[n] / top for n in nodes}


def test_pagerank(spark):
    nodes, edges, seeds = [1, 2, 3, 4, 5], [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0)], {1: 0.9, 5: 0.3}
    allowed = spark.createDataFrame([(9, n) for n in nodes], "qid long, id long")
    e = spark.createDataFrame([(a, b, w, "sequential") for a, b, w in edges], "src long, dst long, weight double, type string")
    s = spark.createDataFrame([(9, n, w) for n, w in seeds.items()], "qid long, id long, weight double")
    want = pagerank(nodes, edges, seeds)
    got = {r.id: r.ppr for r in walk.pagerank(allowed, s, e).collect()}
    assert all(math.isclose(got[n], want[n], abs_tol=2e-4) for n in nodes), (got, want)


def entities_of(text):
    out = set()
    for tok in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b", text):
        if tok.lower() not in ENTITY_STOP_WORDS:
            out |= {x.lower() for x in [tok, *(p for p in re.findall(ENTITY_PARTS, tok) if len(p) > 2)] if x.lower() not in ENTITY_STOP_WORDS}
    return out


def entity_walk(docs, query, k=10):
    has = {d: entities_of(t) for d, t in docs}
    df = Counter(e for s in has.values() for e in s)
    idf = {e: math.log((len(docs) - c + 0.5) / (c + 0.5) + 1) for e, c in df.items()}
    direct = {d: v for d, s in has.items() if (v := sum(idf[e] for e in s & query)) > 0}
    score = dict(direct)
    for d, v in direct.items():
        for e in has[d]:
            if idf[e] > 0.5:
                for other, s in has.items():
                    if other != d and e in s:
                        score[other] = score.get(other, 0) + v * 0.05 * idf[e] / (1 + df[e])
    return sorted(((d, round(v, 6)) for d, v in score.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_entities(spark):
    texts = ["use HttpServer here", "http_client and server", "nothing", "XMLHttpRequest2 for HTTP_PORT", "from self import HttpServer", "élan_vital abc ab server", "ABC_def 12ab port_80 request", "client code of the port", ""] + [f"word{i % 3} item{i} server" for i in range(20)]
    docs = list(enumerate(texts))
    index = walk.entities(spark.createDataFrame(docs, "id long, text string"))
    got = {}
    for r in index.collect():
        got.setdefault(r.id, set()).add(r.entity)
    assert got == {d: e for d, t in docs if (e := entities_of(t))}
    asked = {7: {"httpserver", "http"}, 8: {"client", "item3"}, 9: {"unknown"}}
    q = spark.createDataFrame([(k, e) for k, v in asked.items() for e in v], "qid long, entity string")
    found = {}
    for r in walk.entity_search(index, q, documents=len(docs)).collect():
        found.setdefault(r.qid, []).append((r.rank, r.id, r.score))
    for k, v in asked.items():
        want = entity_walk(docs, v)
        mine = [(d, s) for _, d, s in sorted(found.get(k, []))]
        assert len(mine) == len(want) and all(a == b and math.isclose(x, y, abs_tol=2e-6) for (a, x), (b, y) in zip(mine, want, strict=True)), (mine, want)


def test_hops_go_to_the_end(spark):
    n = 13
    edges = spark.createDataFrame([(i, i + 1, 1.0, "sequential") for i in range(n - 1)], "src long, dst long, weight double, type string")
    every = spark.createDataFrame([(1, i) for i in range(n)], "qid long, id long")
    got = {r.id: r.hop for r in walk.query_hops(every.filter("id = 0"), every, edges).collect()}
    assert got == {i: i for i in range(n)}
    assert max(r.hop for r in walk.query_hops(every.filter("id = 0"), every, edges, deepest=3).collect()) == 3
