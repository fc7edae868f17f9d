"""Queries of the chunk, graph, walk, fusion, briefing and incremental operators over the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import briefing, chunking, dense, fusion, lexical, metrics, topology, walk
from ..operators.tables import table as cut
from ..sources import snapshot
from ..streaming import limiter
from . import oracle as O
from . import search
from .registry_search import batch, docs, table

SIZE = 5
BUDGET = 60


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# chunks


def policies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.policy_of(F.col("text")).alias("policy"))


def chunked(spark, d) -> DataFrame:
    return chunking.nodes(chunking.chunks(table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), "text")))


def chunk_nodes(spark, d):
    return chunked(spark, d).select("doc_id", *long("chunk_index", "n_chunks"), "policy", "id", F.length("text").cast("long").alias("chars"))


def sentences(spark, d):
    """Every sentence of every document: doc_id, place, length."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(X.strip(F.col("text")), r"(?U)(?<=[.!?])\s+")).alias("place", "s"))
    return rows.select("doc_id", *long("place"), F.length("s").cast("long").alias("chars"), F.md5("s").alias("digest"))


def budgets(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text")
    return chunking.budget_pack(t, BUDGET).select("qid", F.col("rank").alias("turn"), *long("spent"))


def excerpts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.mid_excerpts(F.col("text"))).alias("place", "s"))
    return t.select("doc_id", *long("place"), F.md5("s").alias("digest"))


def digest(spark, d):
    return snapshot.digest_of(table(spark, d, "documents"), ["doc_id", "lang", "source", "n_chars"])


# the graph: conversations are sources, turns are chunks


def turns(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), F.col("conv_id").alias("source"), F.col("turn").cast("int").alias("chunk_index"), "text")


def sections(spark, d):
    return topology.fixed_sections(turns(spark, d), SIZE)


def graph_edges(spark, d):
    return topology.sequence_edges(turns(spark, d)).select("src", "dst", "weight", "type")


def graph_sections(spark, d):
    return sections(spark, d).select("id", F.coalesce("successor", F.lit(-1)).alias("successor"), "basin_id", *long("hops"))


def graph_adaptive(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("vector"))
    return topology.adaptive_sections(e, threshold=0.0, longest=8).select("id", "basin_id", *long("hops"))


def graph_attractors(spark, d):
    """Chains, and circles where the conversation's number is odd."""
    w = Window.partitionBy("source").orderBy("chunk_index")
    last = F.last("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lag("id").over(w), F.when((F.col("source") % 2 == 1) & (last != F.col("id")), last))
    return topology.attractors(turns(spark, d).select(F.col("id").alias("node"), nxt.alias("next"))).select("node", "attractor", *long("hops"))


def graph_members(spark, d):
    s = sections(spark, d)
    tree = topology.tree_edges(s).groupBy("basin_id").agg(F.count("*").alias("links"), F.sum("child").alias("children"))
    return topology.members(s).join(tree, "basin_id", "left").select("basin_id", *long("n_members", "depth"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("children", F.lit(0)).alias("children"))


def graph_cohesion(spark, d):
    return topology.cohesion(sections(spark, d), topology.sequence_edges(turns(spark, d)))


def graph_diagnostics(spark, d):
    return topology.diagnostics(sections(spark, d)).select(*long("basins", "nodes", "max_size"), "median_size", "mean_size", "singletons", "mean_hops", "sound")


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def graph_pairs(spark, d):
    return dense.similar_pairs(vectors(spark, d), 0.3)


def graph_virtual(spark, d):
    return topology.virtual_edges(dense.nearest_pairs(vectors(spark, d), 0.3, max(topology.PASSES)))


def graph_summaries(spark, d):
    new = topology.members(sections(spark, d)).select("basin_id", F.lit("extract").alias("l3_summary"), F.lit("extractive").alias("l3_source"))
    old = new.filter("basin_id % 200000 < 100000").withColumns({"l3_summary": F.concat(F.lit("told "), F.col("basin_id").cast("string")), "l3_source": F.when(F.col("basin_id") % 3 == 0, "llm").otherwise("extractive")})
    return topology.keep_summaries(new, old)


# walks over the turns, from the lexical hits of all benchmark items


def _walk(spark, d):
    chunks = cut(sections(spark, d))
    edges = cut(topology.sequence_edges(turns(spark, d)))
    hits = lexical.bm25(lexical.build_index(chunks.select("id", "text")), batch(spark, d), 10)
    return chunks, edges, hits


def walk_candidates(spark, d):
    chunks, edges, hits = _walk(spark, d)
    return walk.expand_candidates(hits.filter("rank <= 5"), chunks, edges).select("qid", "id", *long("place"))


def walk_hops(spark, d):
    chunks, edges, hits = _walk(spark, d)
    seeds = hits.filter("rank <= 3").select("qid", "id")
    return walk.query_hops(seeds, walk.local_subgraph(hits, chunks, edges), edges).select("qid", "id", *long("hop"))


def walk_subgraph(spark, d):
    chunks, edges, hits = _walk(spark, d)
    return walk.local_subgraph(hits, chunks, edges)


def walk_pagerank(spark, d):
    chunks, edges, hits = _walk(spark, d)
    seeds = hits.filter("rank <= 3").select("qid", "id", F.col("score").alias("weight"))
    return walk.pagerank(walk.local_subgraph(hits, chunks, edges), seeds, edges)


def walk_local(spark, d):
    chunks, edges, hits = _walk(spark, d)
    return walk.local_search(fusion.normalized(hits).withColumn("score", F.col("normal")), chunks, edges).select("qid", "id", "score", *long("rank"))


def walk_entities(spark, d):
    q = walk.entities(batch(spark, d).withColumnRenamed("qid", "id")).withColumnRenamed("id", "qid")
    return walk.entity_walk(docs(spark, d), q).select("qid", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), *long("rank"))


# fusion: two vector arms, half of the dimensions and all of them; every hundredth vector is a query


def _arms(spark, d):
    e = vectors(spark, d)
    q = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    half = lambda x: x.withColumn("vector", F.slice("vector", 1, 32))
    return cut(dense.exact_top_k(half(e), half(q), 50)), cut(dense.exact_top_k(e, q, 50))


def _doc(x: DataFrame) -> DataFrame:
    return x.withColumn("doc_id", F.col("id") % 37)


def fuse_rrf(spark, d):
    a, b = _arms(spark, d)
    return fusion.ranked(fusion.weighted_rrf(a, b, 0.40)).select("qid", "id", "score", *long("rank"))


def fuse_allowed(spark, d):
    a, b = _arms(spark, d)
    return fusion.ranked(fusion.weighted_rrf(a, b, allow=b)).select("qid", "id", "score", *long("rank"))


def _signals(b: DataFrame) -> DataFrame:
    i = F.col("id")
    return b.withColumns({"hop": F.when(i % 4 < 3, i % 4), "cohesion": F.when(i % 3 < 2, (i % 10) / 10.0), "centrality": F.when(i % 7 < 5, (i % 11) / 11.0), "memory": F.lit(None).cast("double")})


def fuse_hops(spark, d):
    _, b = _arms(spark, d)
    hops = _signals(b).filter("hop is not null")
    n, p = (fusion.hop_prior(b.select("qid", "id", "score"), hops, m) for m in ("neutral", "penalty"))
    return n.withColumnRenamed("score", "neutral").join(p.withColumnRenamed("score", "penalty"), ["qid", "id"])


def fuse_signals(spark, d):
    return fusion.signal_rank(_signals(_arms(spark, d)[1])).select("qid", "id", "score")


def fuse_membership(spark, d):
    return fusion.first_of_documents(_doc(_arms(spark, d)[0])).select("qid", "doc_id", "id", *long("place"))


def fuse_collapse(spark, d):
    return fusion.collapse(_doc(_arms(spark, d)[1])).select("qid", "doc_id", *long("rank"))


def fuse_diversify(spark, d):
    return fusion.diversify(_doc(_arms(spark, d)[1]), 20).select("qid", "doc_id", "id", *long("rank"))


def fuse_rescue(spark, d):
    a, b = map(_doc, _arms(spark, d))
    order = fusion.diversify(b, 10).select("qid", "id", "doc_id", "rank")
    return fusion.rescue(order, a, b, 10).select("qid", "doc_id", "id", *long("rank"))


def fuse_gate(spark, d):
    a, b = _arms(spark, d)
    both = b.select("qid", "id", F.col("score").alias("dense_score")).join(a.select("qid", "id", F.col("score").alias("bm25_score")), ["qid", "id"], "left").filter("dense_score < 0.999")
    return fusion.confidence_gate(both, dense=0.42, lexical=0.30).groupBy("qid").agg(F.count("*").alias("hits"))


def fuse_rerank(spark, d):
    b = _arms(spark, d)[1].withColumn("rerank_score", F.when(F.col("rank") <= 25, (F.col("id") % 13) / 13.0))
    tail = fusion.tail_scores(b).select("qid", "id", F.round("final", 6).alias("final"))
    return fusion.rerank_head(b, 30).join(tail, ["qid", "id"]).join(fusion.normalized(b).select("qid", "id", "normal"), ["qid", "id"]).select("qid", "id", *long("rank"), "final", "normal")


def fuse_export(spark, d):
    return fusion.run_export(_doc(_arms(spark, d)[1]), 10).select("qid", "doc_id", "score")


def fuse_ann(spark, d):
    """Recall of the approximate search against the exact one, over every hundredth vector: one row."""
    e = vectors(spark, d)
    q = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    miss = dense.ann_misses(lexical.top_k(dense.exact_top_k(e, q, 10, floor=-2.0), 10), dense.approximate_top_k(e, q, 10))
    return miss.agg(F.count("*").alias("queries"), (1 - F.sum("missed") / F.sum("exact") >= 0.9).alias("recall_reached"))


def basins(spark, d):
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    m = e.select(F.col("vec_id").alias("id"), F.first("vec_id").over(w).alias("basin_id"), (F.row_number().over(w) - 1).cast("int").alias("hops"), F.col("embedding").alias("vector"), F.lit(None).cast("array<float>").alias("summary"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return dense.basin_search(m, q, 3, 4).select("qid", "basin_id", *long("basin_rank"), "id", *long("rank"))


def _pieces(spark, d) -> DataFrame:
    """The chunks; an id names document, place and text, so it stands twice only where a document does."""
    pieces = chunked(spark, d)
    if table(spark, d, "documents").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        pieces = pieces.dropDuplicates(["id"])
    return cut(pieces.select("id", "doc_id", "text"))


def hybrid_long(spark, d):
    """The long-document search: every benchmark item over the chunks of every document."""
    return search.long_hybrid(_pieces(spark, d), batch(spark, d)).hybrid.select("qid", "id", "doc_id", *long("rank"))


# briefing


def routes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", briefing.route(F.col("text")).alias("route"))


def _spans(spark, d):
    n = F.count("*").over(Window.partitionBy("source"))
    i = F.col("chunk_index")
    return sections(spark, d).withColumn("parent_span", F.array(F.greatest(F.lit(0), i - 3), F.least((n - 1).cast("int"), i + 3)))


def contexts(spark, d):
    c = _spans(spark, d)
    return briefing.parent_windows(c.select(F.col("source").alias("qid"), "id"), c).select("qid", "id", F.md5("context").alias("context"))


def mates(spark, d):
    c = sections(spark, d)
    hits = c.filter("chunk_index < 2").select(F.col("source").alias("qid"), "id", (F.col("chunk_index") + 1).alias("rank"))
    return briefing.basin_mates(hits, c, 4).select("qid", "id", *long("place"))


def packets(spark, d):
    chunks = cut(_spans(spark, d))
    hits = lexical.bm25(lexical.build_index(chunks.select("id", "text")), batch(spark, d), 20)
    p = briefing.packets(hits, chunks, 5, labels=briefing.basin_labels(chunks))
    told = briefing.contexts(p, 400)
    shown = briefing.as_documents(p, chunks, 8).groupBy("qid").agg(F.count("*").alias("documents"))
    return p.join(told, "qid").join(shown, "qid").select("qid", F.size("hubs").cast("long").alias("hubs"), F.size("neighbors").cast("long").alias("neighbors"), F.size("satellites").cast("long").alias("satellites"), F.md5("context").alias("context"), "documents")


def labels(spark, d):
    return briefing.basin_labels(sections(spark, d))


def support(spark, d):
    e = vectors(spark, d)
    _, b = _arms(spark, d)
    hubs = b.filter("rank between 2 and 6")
    q = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    out = briefing.confidence(hubs, e, q)
    return out.select("qid", "confidence", briefing.abstains(F.lit("text"), F.col("confidence"), 0.4).alias("abstains"))


def evidence(spark, d):
    return briefing.evidence_rows(sections(spark, d), most=3, chars=40).select("basin_id", *long("place"), "text")


def citations(spark, d):
    t = table(spark, d, "conversations")
    answer = F.concat("text", F.lit(" [ref:"), F.col("turn").cast("string"), F.lit("] [ref:0]"))
    return t.select("conv_id", "turn", briefing.citations_hold(answer, F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("holds"))


def passages(spark, d):
    """Passage recall: the best chunks of whole documents, as the long-document search ranks them, against each item's own text."""
    c = _pieces(spark, d)
    run = search.long_hybrid(c, batch(spark, d)).hybrid.select("qid", "id", "rank").join(c.select("id", "text"), "id")
    return metrics.passage_recall(run, batch(spark, d).select("qid", F.col("text").alias("gold")))


# files, incremental maintenance, streams


def sync_states(spark, d):
    """Documents whose number of characters changed by a rule stand for changed files; languages for what came and went."""
    t = table(spark, d, "documents")
    name = F.col("doc_id").cast("string").alias("source")
    old = t.filter("lang <> 'fr'").select(name, F.md5("text").alias("sha256"))
    new = t.filter("lang <> 'de'").select(name, F.when(F.col("n_chars") % 5 == 0, F.sha2("text", 256)).otherwise(F.md5("text")).alias("sha256"), F.when(F.col("n_chars") % 7 == 0, "error").otherwise("ok").alias("status"))
    return snapshot.classify(old, new)


def merged(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    new = t.filter("lang = 'en'").withColumn("lang", F.lit("new"))
    return snapshot.merge(t, t.filter("lang = 'es'"), new).groupBy("source", "lang").agg(F.count("*").alias("chunks"))


def latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return snapshot.latest(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


def limits(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    return limiter.limited(e.withColumn("at", F.col("us") / 1e6), ["user_id"], limit=3, window=86_400.0, order="event_id").select("event_id", "user_id", "allowed")


def tumbling(spark, d):
    out = limiter.windowed_counts(table(spark, d, "events").select("ts", "event_type", "value"), size="1 day")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "events", F.round("total", 2).alias("total"))


QUERIES = {
    "chunk_policy": policies, "chunk_nodes": chunk_nodes, "chunk_sentences": sentences, "chunk_budget": budgets, "chunk_excerpts": excerpts, "table_digest": digest,
    "graph_edges": graph_edges, "graph_sections": graph_sections, "graph_adaptive": graph_adaptive, "graph_attractors": graph_attractors, "graph_members": graph_members,
    "graph_cohesion": graph_cohesion, "graph_diagnostics": graph_diagnostics, "graph_pairs": graph_pairs, "graph_virtual_edges": graph_virtual, "graph_summaries": graph_summaries,
    "walk_candidates": walk_candidates, "walk_hops": walk_hops, "walk_subgraph": walk_subgraph, "walk_pagerank": walk_pagerank, "walk_local_search": walk_local, "walk_entities": walk_entities,
    "fusion_rrf": fuse_rrf, "fusion_allowlist": fuse_allowed, "fusion_hop_prior": fuse_hops, "fusion_signals": fuse_signals, "fusion_membership": fuse_membership, "fusion_collapse": fuse_collapse,
    "fusion_diversify": fuse_diversify, "fusion_rescue": fuse_rescue, "fusion_confidence_gate": fuse_gate, "fusion_rerank": fuse_rerank, "fusion_export": fuse_export,
    "dense_approximate": fuse_ann, "dense_basins": basins, "hybrid_long": hybrid_long,
    "briefing_route": routes, "briefing_windows": contexts, "briefing_mates": mates, "briefing_packets": packets, "briefing_labels": labels, "briefing_confidence": support,
    "briefing_evidence": evidence, "briefing_citations": citations, "metrics_passages": passages,
    "sync_states": sync_states, "sync_merge": merged, "sync_latest": latest, "stream_limiter": limits, "stream_windows": tumbling,
}

# oracles

_TURN = "t AS (SELECT conv_id * 100000 + turn AS id, conv_id AS source, turn AS chunk_index, text FROM conversations)"
_SEC = f"""{_TURN}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_index, id) - 1 AS place, lag(id) OVER (PARTITION BY source ORDER BY chunk_index, id) AS prev FROM t),
s AS (SELECT id, source, chunk_index, text, place, CASE WHEN place % {SIZE} > 0 THEN prev END AS successor, first_value(id) OVER (PARTITION BY source, place // {SIZE} ORDER BY place) AS basin_id, place % {SIZE} AS hops FROM p)"""
_EDGE = "ed AS (SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY source ORDER BY chunk_index, id) AS dst, 1.0::DOUBLE AS weight, 'sequential' AS type FROM t) WHERE dst IS NOT NULL)"


def _arm(name: str, part: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ("
        f"SELECT q.vec_id AS qid, e.vec_id AS id, round(list_dot_product((q.embedding::DOUBLE[]){part}, (e.embedding::DOUBLE[]){part}), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) "
        "WHERE rank <= 50 AND (score >= 0.05 OR rank = 1))"
    )


_ARMS = f"{_arm('a', '[1:32]')}, {_arm('b', '')}"
_SIG = "sg AS (SELECT *, CASE WHEN id % 4 < 3 THEN id % 4 END AS hop, CASE WHEN id % 3 < 2 THEN (id % 10) / 10.0::DOUBLE END AS cohesion, CASE WHEN id % 7 < 5 THEN (id % 11) / 11.0::DOUBLE END AS centrality FROM b)"
_DIV = "dv AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c, best DESC, first) AS r FROM (SELECT *, id % 37 AS doc_id, row_number() OVER (PARTITION BY qid, id % 37 ORDER BY rank) AS c, max(score) OVER (PARTITION BY qid, id % 37) AS best, min(rank) OVER (PARTITION BY qid, id % 37) AS first FROM b))"
_TOP = "(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)"


_HITS = f"{_SEC}, {_EDGE}, both_ways AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), {O.INDEX_OF_TURNS}, {O.QUERIES}, {O.bm25(10)}"


def _alt(words: list[str]) -> str:
    import re

    return "|".join(re.escape(w).replace("'", "''") for w in words)


def _entities(name: str, source: str, key: str) -> str:
    """CTE <name> (key, e): identifiers and their parts; separators stand for the look-ahead that this dialect lacks."""
    stop = O.words(list(L.ENTITY_STOP_WORDS))
    cut = "regexp_replace(regexp_replace(w, '[A-Z]+_', '_', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return (
        f"{name}_w AS (SELECT DISTINCT {key}, w FROM (SELECT {key}, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}) WHERE regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AND NOT list_contains({stop}, lower(w))), "
        f"{name} AS MATERIALIZED (SELECT DISTINCT {key}, e FROM (SELECT {key}, lower(w) AS e FROM {name}_w UNION ALL SELECT {key}, lower(p) FROM (SELECT {key}, unnest(regexp_extract_all({cut}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) AS p FROM {name}_w) WHERE length(p) > 2) WHERE NOT list_contains({stop}, e))"
    )


_W = "[^\\p{L}\\p{N}_]"
_LATIN, _OTHER = [w for w in L.OVERVIEW_WORDS if not briefing._is_cjk(w)], [w for w in L.OVERVIEW_WORDS if briefing._is_cjk(w)]
_BOUND = lambda ws: f"(^|{_W})({_alt(ws)})($|{_W})"
_CJK = "[一-鿿぀-ヿ가-힯]"


def _rest() -> str:
    out = "q"
    for p in [*L.OVERVIEW_PHRASES, *L.COMPARE_PHRASES]:
        out = f"replace({out}, '{p.replace(chr(39), chr(39) * 2)}', ' ')"
    for ws in (_LATIN, L.COMPARE_WORDS):
        for _ in range(2):
            out = f"regexp_replace({out}, '{_BOUND(ws)}', ' ', 'g')"
    return f"regexp_replace({out}, '{_alt(_OTHER)}', ' ', 'g')"


ORACLE_SQL = {
    "chunk_policy": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 4000 THEN 'sentence_window' ELSE 'legacy_char' END AS policy FROM documents",
    "chunk_sentences": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)
SELECT doc_id, i - 1 AS place, length(l[i])::BIGINT AS chars, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)""",
    "chunk_budget": rf"""WITH w AS (SELECT conv_id AS qid, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations WHERE text <> ''),
r AS (SELECT *, sum(n) OVER x AS spent, row_number() OVER x AS place FROM w WINDOW x AS (PARTITION BY qid ORDER BY turn)),
o AS (SELECT *, max(CASE WHEN spent > {BUDGET} AND place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY turn) AS over FROM r) SELECT qid, turn, spent::BIGINT AS spent FROM o WHERE over = 0""",
    "chunk_excerpts": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), w AS (SELECT doc_id, t, substr(t, (length(t) // 3 + 1)::BIGINT, least(length(t) - length(t) // 3, 2400)) AS w FROM t),
c AS (SELECT doc_id, CASE WHEN length(t) < 800 THEN CASE WHEN t = '' THEN [] ELSE [t] END ELSE list_filter(list_transform(range(0, 3), lambda i: regexp_replace(substr(w, i * greatest(400, length(w) // 3) + 1, 400), '^\s+|\s+$', '', 'g')), lambda x: length(x) > 80) END AS l FROM w)
SELECT doc_id, i - 1 AS place, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM c)""",
    "table_digest": """WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(n_chars::VARCHAR, chr(0)))) AS h FROM documents),
p AS (SELECT substr(h, 1, 3) AS p, h, count(*) AS n FROM h GROUP BY ALL), l AS (SELECT p, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS h FROM p GROUP BY p)
SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM l""",
    "graph_edges": f"WITH {_TURN}, {_EDGE} SELECT * FROM ed",
    "graph_sections": f"WITH {_SEC} SELECT id, coalesce(successor, -1) AS successor, basin_id, hops::BIGINT AS hops FROM s",
    "graph_adaptive": """WITH RECURSIVE e AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings),
c AS (SELECT id, label, place, list_cosine_similarity(u, v) AS sim FROM e),
w AS (SELECT label, place, id, place AS start, id AS basin_id FROM c WHERE place = 0 UNION ALL
SELECT c.label, c.place, c.id, CASE WHEN c.place - w.start >= 8 OR (c.place - w.start >= 3 AND sim < 0.0) THEN c.place ELSE w.start END, CASE WHEN c.place - w.start >= 8 OR (c.place - w.start >= 3 AND sim < 0.0) THEN c.id ELSE w.basin_id END
FROM w JOIN c ON c.label = w.label AND c.place = w.place + 1) SELECT id, basin_id, place - start AS hops FROM w""",
    "graph_attractors": f"WITH {_TURN} SELECT id AS node, min(id) OVER (PARTITION BY source) AS attractor, row_number() OVER (PARTITION BY source ORDER BY chunk_index) - 1 AS hops FROM t",
    "graph_members": f"WITH {_SEC} SELECT basin_id, count(*) AS n_members, max(hops)::BIGINT AS depth, count(successor) AS links, coalesce(sum(CASE WHEN successor IS NOT NULL THEN id END), 0)::BIGINT AS children FROM s GROUP BY basin_id",
    "graph_cohesion": f"""WITH {_SEC}, {_EDGE}, b2 AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed),
m AS (SELECT x.basin_id, sum(CASE WHEN x.basin_id = y.basin_id THEN weight ELSE 0 END) AS inside, sum(weight) AS total FROM b2 JOIN s x ON x.id = src JOIN s y ON y.id = dst GROUP BY 1), z AS (SELECT basin_id, count(*) AS n FROM s GROUP BY 1)
SELECT basin_id, CASE WHEN n = 1 OR coalesce(total, 0) = 0 THEN 1.0 ELSE round_even(inside / total, 2) END::DOUBLE AS cohesion FROM z LEFT JOIN m USING (basin_id)""",
    "graph_diagnostics": f"""WITH {_SEC}, z AS (SELECT basin_id, count(*) AS n, sum(hops) AS h FROM s GROUP BY 1)
SELECT count(*) AS basins, sum(n)::BIGINT AS nodes, max(n) AS max_size, median(n)::DOUBLE AS median_size, round(avg(n), 6) AS mean_size, round(count(*) FILTER (n = 1) / count(*), 6) AS singletons, round(sum(h) / sum(n), 6) AS mean_hops, median(n) >= 3 AND count(*) FILTER (n = 1) / count(*) < 0.40 AS sound FROM z""",
    "graph_pairs": "WITH p AS (SELECT x.vec_id AS src, y.vec_id AS dst, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) SELECT * FROM p WHERE sim >= 0.3",
    "graph_summaries": f"""WITH {_SEC}, n AS (SELECT DISTINCT basin_id FROM s) SELECT basin_id, CASE WHEN basin_id % 200000 < 100000 AND basin_id % 3 = 0 THEN 'told ' || basin_id ELSE 'extract' END AS l3_summary,
CASE WHEN basin_id % 200000 < 100000 AND basin_id % 3 = 0 THEN 'llm' ELSE 'extractive' END AS l3_source FROM n""",
    "fusion_rrf": f"WITH {_ARMS}, f AS (SELECT qid, id, round(sum(p), 8) AS score FROM (SELECT qid, id, 0.4::DOUBLE / (60 + rank) AS p FROM a UNION ALL SELECT qid, id, 0.6::DOUBLE / (60 + rank) FROM b) GROUP BY ALL) SELECT * FROM {_TOP}",
    "fusion_allowlist": f"WITH {_ARMS}, f AS (SELECT qid, id, round(sum(p), 8) AS score FROM (SELECT qid, id, 0.15::DOUBLE / (60 + rank) AS p FROM a WHERE (qid, id) IN (SELECT (qid, id) FROM b) UNION ALL SELECT qid, id, 0.85::DOUBLE / (60 + rank) FROM b) GROUP BY ALL) SELECT * FROM {_TOP}",
    "fusion_hop_prior": f"WITH {_ARMS}, {_SIG}, m AS (SELECT *, max(hop) OVER (PARTITION BY qid) AS far FROM sg) SELECT qid, id, round(score * (0.7 + 0.3 * exp(-0.35 * coalesce(hop, 0))), 8) AS neutral, round(score * (0.7 + 0.3 * exp(-0.35 * coalesce(hop, coalesce(far, 0) + 1))), 8) AS penalty FROM m",
    "fusion_signals": f"""WITH {_ARMS}, {_SIG}, n AS (SELECT *, score / greatest(max(score) OVER (PARTITION BY qid), 1e-12) AS base FROM sg)
SELECT qid, id, round(0.5 + 0.5 * tanh((0.4 * base + coalesce(0.2 * exp(-0.35 * hop), 0) + coalesce(0.15 * cohesion, 0) + coalesce(0.15 * centrality, 0))
/ (0.4 + CASE WHEN hop IS NULL THEN 0 ELSE 0.2 END + CASE WHEN cohesion IS NULL THEN 0 ELSE 0.15 END + CASE WHEN centrality IS NULL THEN 0 ELSE 0.15 END) - 0.5), 8) AS score FROM n""",
    "fusion_membership": f"WITH {_ARMS}, n AS (SELECT *, id % 37 AS doc_id, row_number() OVER (PARTITION BY qid, id % 37 ORDER BY rank) AS n FROM a), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM n WHERE n = 1) SELECT qid, doc_id, id, place FROM m WHERE place <= 10",
    "fusion_collapse": f"WITH {_ARMS} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY first, doc_id) AS rank FROM (SELECT qid, id % 37 AS doc_id, min(rank) AS first FROM b GROUP BY ALL)",
    "fusion_diversify": f"WITH {_ARMS}, {_DIV} SELECT qid, doc_id, id, r AS rank FROM dv WHERE r <= 20",
    "fusion_rescue": f"""WITH {_ARMS}, {_DIV}, o AS (SELECT qid, id, doc_id, r FROM dv WHERE r <= 10),
nw AS (SELECT qid, id, id % 37 AS doc_id, rank FROM a WHERE (qid, id) NOT IN (SELECT (qid, id) FROM b) AND (qid, id % 37) NOT IN (SELECT (qid, doc_id) FROM o)),
x AS (SELECT qid, id, doc_id, e FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS e FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS n FROM nw) WHERE n = 1) WHERE e <= 2),
c AS (SELECT qid, max(e) AS n FROM x GROUP BY qid), k AS (SELECT o.qid, id, doc_id, CASE WHEN n IS NULL OR r <= least(2, greatest(0, 10 - n)) THEN r ELSE r + n END AS rank FROM o LEFT JOIN c USING (qid)
UNION ALL SELECT x.qid, id, doc_id, least(2, greatest(0, 10 - n)) + e FROM x JOIN c USING (qid)) SELECT qid, doc_id, id, rank::BIGINT AS rank FROM k WHERE rank <= 10""",
    "fusion_confidence_gate": f"WITH {_ARMS}, j AS (SELECT b.qid, b.id, b.score AS ds, a.score AS ls FROM b LEFT JOIN a ON a.qid = b.qid AND a.id = b.id WHERE b.score < 0.999) SELECT qid, count(*) AS hits FROM j GROUP BY qid HAVING NOT (coalesce(max(ds), 0) < 0.42 AND coalesce(max(ls), 0) < 0.30)",
    "fusion_rerank": f"""WITH {_ARMS}, r AS (SELECT *, CASE WHEN rank <= 25 THEN (id % 13) / 13.0::DOUBLE END AS rs FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 30 THEN 0 ELSE 1 END, CASE WHEN rank <= 30 THEN -rs ELSE rank END NULLS FIRST, id) AS nr, score / (max(score) OVER (PARTITION BY qid) + 1e-6) AS norm, coalesce(min(rs) OVER (PARTITION BY qid), 1.0) AS low FROM r)
SELECT qid, id, nr AS rank, round(coalesce(rs, 0.95 * low * (0.5 * norm + 0.5 / (1 + 0.003 * (rank - 1)))), 6) AS final, round(norm, 6) AS normal FROM n WHERE nr <= 30""",
    "fusion_export": f"WITH {_ARMS}, f AS (SELECT qid, id % 37 AS doc_id, min(rank) AS r, arg_min(score, rank) AS score FROM b WHERE rank <= 20 GROUP BY ALL) SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, doc_id) AS n FROM f) WHERE n <= 10",
    "dense_approximate": "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0",
    "dense_basins": """WITH m AS (SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label) AS basin_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS hops, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT qid, q.v AS qv, basin_id, round(list_cosine_similarity(q.v, m.v), 6) AS s FROM q, m WHERE id = basin_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, basin_id) AS basin_rank, max(s) OVER (PARTITION BY qid) AS best FROM h) WHERE basin_rank <= 3 AND best > 1e-9),
i AS (SELECT qid, t.basin_id, basin_rank, id, row_number() OVER (PARTITION BY qid, t.basin_id ORDER BY round(list_cosine_similarity(qv, m.v), 6) DESC, hops, id) AS rank FROM t JOIN m ON m.basin_id = t.basin_id) SELECT * FROM i WHERE rank <= 4""",
    "briefing_route": f"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS q FROM conversations),
f AS (SELECT *, regexp_replace(q, '^[?.! ]+|[?.! ]+$', '', 'g') AS bare, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS n, {_rest()} AS rest,
regexp_matches(q, '{_alt(L.OVERVIEW_PHRASES + _OTHER)}') OR regexp_matches(q, '{_BOUND(_LATIN)}') AS ov, regexp_matches(q, '{_alt(L.COMPARE_PHRASES)}') OR regexp_matches(q, '{_BOUND(L.COMPARE_WORDS)}') AS cm FROM t)
SELECT conv_id, turn, CASE WHEN list_contains({O.words(L.OVERVIEW_WORDS + L.OVERVIEW_PHRASES)}, bare) THEN 'global' WHEN regexp_matches(q, '{_alt(L.LOCAL_PHRASES)}') THEN 'local'
WHEN n <= 3 OR (regexp_matches(q, '{_CJK}') AND length(q) <= 12) THEN CASE WHEN ov THEN 'global' ELSE 'hybrid' END WHEN NOT (ov OR cm) THEN 'hybrid'
WHEN len(list_filter(regexp_split_to_array(rest, '\\s+'), lambda w: length(w) > 3 AND NOT list_contains({O.words(L.FILLER)}, w))) <= 3 THEN 'global' ELSE 'hybrid' END AS route FROM f""",
    "briefing_windows": f"""WITH {_TURN}, x AS (SELECT a.source AS qid, a.id, b.text, min(CASE WHEN b.id = a.id THEN -1 ELSE b.chunk_index END) AS spot FROM t a JOIN t b ON b.source = a.source AND b.chunk_index BETWEEN greatest(0, a.chunk_index - 3) AND a.chunk_index + 3 WHERE b.text <> '' GROUP BY ALL)
SELECT qid, id, md5(string_agg(text, chr(10) || chr(10) ORDER BY spot)) AS context FROM x GROUP BY qid, id""",
    "briefing_mates": f"""WITH {_SEC}, h AS (SELECT source AS qid, basin_id, min(chunk_index) AS seed FROM s WHERE chunk_index < 2 GROUP BY ALL),
m AS (SELECT h.qid, s.id, row_number() OVER (PARTITION BY h.qid ORDER BY seed, hops, s.id) AS place FROM h JOIN s ON s.basin_id = h.basin_id WHERE s.chunk_index >= 2) SELECT * FROM m WHERE place <= 4""",
    "briefing_confidence": f"WITH {_ARMS} SELECT qid, greatest(0.0, max(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6))) AS confidence, greatest(0.0, max(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6))) < 0.4 AS abstains FROM b JOIN embeddings x ON x.vec_id = qid JOIN embeddings y ON y.vec_id = id WHERE rank BETWEEN 2 AND 6 GROUP BY qid",
    "briefing_evidence": f"WITH {_SEC}, r AS (SELECT basin_id, row_number() OVER (PARTITION BY basin_id ORDER BY hops, id) AS place, substr(text, 1, 40) AS text FROM s) SELECT * FROM r WHERE place <= 3",
    "briefing_citations": "SELECT conv_id, turn, len(list_filter(list_concat(regexp_extract_all(text, '\\[ref:([^\\]]+)\\]', 1), [turn::VARCHAR, '0']), lambda r: NOT list_contains(['0', '1', '2'], r))) = 0 AS holds FROM conversations",
    "walk_subgraph": f"""WITH {_HITS}, core AS (SELECT DISTINCT bm.qid, y.id FROM bm JOIN s x ON x.id = bm.id JOIN s y ON y.basin_id = x.basin_id WHERE rank <= 3 UNION SELECT qid, id FROM bm WHERE rank <= 10)
SELECT * FROM core UNION SELECT qid, dst FROM core JOIN both_ways ON src = id""",
    "walk_candidates": f"""WITH {_HITS}, sd AS (SELECT qid, id, rank AS seed FROM bm WHERE rank <= 5), w1 AS (SELECT qid, dst AS id, seed FROM sd JOIN both_ways ON src = id), w2 AS (SELECT DISTINCT qid, dst AS id, seed FROM w1 JOIN both_ways ON src = id),
ev AS (SELECT qid, id, 1 AS stage, seed, 1 AS far FROM w1 UNION ALL SELECT qid, id, 1, seed, 2 FROM w2 UNION ALL SELECT qid, y.id, 2, seed, 0 FROM sd JOIN s x ON x.id = sd.id JOIN s y ON y.basin_id = x.basin_id),
k AS (SELECT qid, id, min({{'a': stage, 'b': seed, 'c': far}}) AS k FROM ev WHERE (qid, id) NOT IN (SELECT (qid, id) FROM sd) GROUP BY ALL),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS place FROM k) SELECT * FROM r WHERE place <= 100""",
    "walk_hops": f"""WITH RECURSIVE {_HITS}, core AS (SELECT DISTINCT bm.qid, y.id FROM bm JOIN s x ON x.id = bm.id JOIN s y ON y.basin_id = x.basin_id WHERE rank <= 3 UNION SELECT qid, id FROM bm WHERE rank <= 10),
al AS (SELECT * FROM core UNION SELECT qid, dst FROM core JOIN both_ways ON src = id), h AS (SELECT qid, id, 0 AS hop FROM bm WHERE rank <= 3 UNION SELECT h.qid, dst, hop + 1 FROM h JOIN both_ways ON src = h.id JOIN al ON al.qid = h.qid AND al.id = dst WHERE hop < 64)
SELECT qid, id, min(hop)::BIGINT AS hop FROM h GROUP BY ALL""",
    "walk_entities": f"""WITH {_entities("de", "(SELECT doc_id AS id, text FROM documents)", "id")}, {_entities("qe", "(SELECT item_id AS qid, text FROM benchmark)", "qid")},
n AS (SELECT count(*) AS n FROM documents), st AS MATERIALIZED (SELECT e, count(*) AS df, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM de, n GROUP BY e),
dir AS MATERIALIZED (SELECT qid, id, sum(idf) AS s FROM qe JOIN st USING (e) JOIN de USING (e) GROUP BY ALL), ra AS MATERIALIZED (SELECT id, e, 0.05 * idf / (1 + df) AS damped FROM de JOIN st USING (e) WHERE idf > 0.5),
ms AS (SELECT qid, e, sum(s * damped) AS m FROM dir JOIN ra USING (id) GROUP BY ALL), th AS (SELECT qid, id, sum(m) AS more FROM ms JOIN ra USING (e) GROUP BY ALL), ow AS (SELECT qid, id, s * sum(damped) AS own FROM dir JOIN ra USING (id) GROUP BY qid, id, s),
f AS (SELECT coalesce(dir.qid, th.qid) AS qid, coalesce(dir.id, th.id) AS id, coalesce(s, 0) + coalesce(more, 0) AS total FROM dir FULL JOIN th ON dir.qid = th.qid AND dir.id = th.id),
g AS (SELECT f.qid, f.id, round(total - coalesce(own, 0), 6) AS score FROM f LEFT JOIN ow ON ow.qid = f.qid AND ow.id = f.id)
SELECT qid, id AS doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM g WHERE score > 0) WHERE rank <= 10""",
    "sync_states": """WITH o AS (SELECT doc_id::VARCHAR AS source, md5(text) AS h FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id::VARCHAR AS source, CASE WHEN n_chars % 5 = 0 THEN sha256(text) ELSE md5(text) END AS h, n_chars % 7 <> 0 AS ok FROM documents WHERE lang <> 'de'),
j AS (SELECT source, o.h AS was, n.h AS now, CASE WHEN n.h IS NULL THEN 'deleted' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'same' WHEN NOT ok THEN 'failed' WHEN o.h IS NULL THEN 'new' ELSE 'changed' END AS state FROM o FULL JOIN n USING (source))
SELECT source, state, CASE WHEN state = 'failed' THEN was WHEN state <> 'deleted' THEN now END AS sha256 FROM j""",
    "sync_merge": "WITH o AS (SELECT source, lang FROM documents WHERE lang <> 'en' AND source NOT IN (SELECT source FROM documents WHERE lang = 'es') UNION ALL SELECT source, 'new' FROM documents WHERE lang = 'en') SELECT source, lang, count(*) AS chunks FROM o GROUP BY ALL",
    "sync_latest": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "stream_windows": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL",

}

