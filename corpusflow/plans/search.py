"""Whole searches as one plan over a batch of queries: flat and long-document hybrids, with their arms kept for audits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import QUERY_PROMPT
from ..operators import dense, fusion, lexical, topology, walk
from ..operators.tables import table


@dataclass
class Arms:
    index: lexical.LexicalIndex
    bm25: DataFrame
    dense: DataFrame
    hybrid: DataFrame


@dataclass(frozen=True)
class Options:
    """What a search does beyond fusing its two arms.

    encoder: texts -> vectors in place of the hashed one (``prompt`` goes before queries then); stem: terms -> terms;
    graph: candidates around the first hits; hops: a prior by distance from them (``missing`` as in ``fusion.hop_prior``);
    signals: several signals instead of the fused score alone; gate: nothing for queries whose arms are both weak.
    """

    k: int = 10
    pool: int | None = None
    alpha: float | None = None
    encoder: Callable[[list[str]], list[list[float]]] | None = None
    prompt: str = QUERY_PROMPT
    stem: Callable[[list[str]], list[str]] | None = None
    graph: bool = False
    hops: bool = False
    signals: bool = False
    gate: bool = False
    missing: str = "neutral"
    extra: int = 100


def query_vectors(index: lexical.LexicalIndex, queries: DataFrame) -> DataFrame:
    """qid, vector: hashed vectors with the statistics of the index."""
    q = table(lexical.query_terms(queries, index.stem).select(F.col("qid").alias("id"), "term", F.col("times").alias("tf")))
    return dense.hashed(index, q, index.terms_of(q.select("term").distinct())).withColumnRenamed("id", "qid")


def vectors(index: lexical.LexicalIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed vectors of the documents and of the queries (id is qid there), with the statistics of the index."""
    return dense.hashed(index, index.postings), query_vectors(index, queries)


def _vectors(index: lexical.LexicalIndex, texts: DataFrame, queries: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    if o.encoder is None:
        return vectors(index, queries)
    return dense.encoded(texts, o.encoder), dense.encoded(queries, o.encoder, "qid", o.prompt).withColumnRenamed("id", "qid")


def _near(index: lexical.LexicalIndex, texts: DataFrame, queries: DataFrame, o: Options, pool: int) -> DataFrame:
    if o.encoder is None:
        return dense.hashed_top_k(index, query_vectors(index, queries), pool)
    return dense.exact_top_k(*_vectors(index, texts, queries, o), pool)


def flat_hybrid(docs: DataFrame, queries: DataFrame, k: int = 10, pool: int = 50, alpha: float = fusion.ALPHA_FLAT) -> Arms:
    """docs: id, text.  Dense hits are the members, lexical ranks only weigh in; the best ``k`` by fused score then id."""
    return hybrid(docs, queries, Options(k=k, pool=pool, alpha=alpha), long=False)


def long_hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, pool: int = 200, alpha: float = fusion.ALPHA_LONG) -> Arms:
    """chunks: id, doc_id, text.  Two lexical passes (the second with feedback terms), the first chunks of the best lexical
    documents join the members, documents take turns, and lexical documents that were left out are spliced in."""
    return hybrid(chunks, queries, Options(k=k, pool=pool, alpha=alpha), long=True)


def first_hits(dense_hits: DataFrame, lexical_hits: DataFrame, n: int) -> DataFrame:
    """qid, id, rank: the first ``n`` of the vector arm, then the first ``n`` of the lexical one, each once."""
    both = dense_hits.filter(F.col("rank") <= n).select("qid", "id", F.col("rank").alias("at")).unionByName(lexical_hits.filter(F.col("rank") <= n).select("qid", "id", (F.col("rank") + n).alias("at")))
    once = both.groupBy("qid", "id").agg(F.min("at").alias("at"))
    return once.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("rank"))


def hybrid(chunks: DataFrame, queries: DataFrame, o: Options, long: bool, edges: DataFrame | None = None) -> Arms:
    """chunks: id, text; doc_id for long documents; basin_id, successor and ``edges`` (src, dst, weight, type) for what needs the graph."""
    if (o.graph or o.hops or o.signals) and edges is None:
        raise ValueError("graph, hops and signals need the edges of the chunks")
    pool = o.pool or (200 if long else 50)
    alpha = o.alpha if o.alpha is not None else fusion.ALPHA_LONG if long else fusion.ALPHA_FLAT
    index = lexical.build_index(chunks, stem=o.stem)
    words = lexical.bm25(index, queries, pool)
    if long:
        more = lexical.expansion_terms(index, queries, words, chunks)
        words = table(lexical.union_passes(words, lexical.bm25(index, lexical.expanded(queries, more), pool)))
    near = table(_near(index, chunks.select("id", "text"), queries, o, pool))
    members, ranks = near.select("qid", "id"), near.select("qid", "id", "rank")
    every = members.unionByName(words.select("qid", "id"))
    if o.graph:
        around = table(walk.expand_candidates(first_hits(near, words, 5), chunks, edges, most=o.extra))
        members, every = members.unionByName(around.select("qid", "id")), every.unionByName(around.select("qid", "id"))
        # nodes that only the graph found stand behind the vector arm's hits
        new = around.join(near.select("qid", "id"), ["qid", "id"], "left_anti").join(words.select("qid", "id"), ["qid", "id"], "left_anti")
        last = near.groupBy("qid").agg(F.max("rank").alias("last"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
        ranks = ranks.unionByName(new.join(last, "qid", "left").select("qid", "id", (F.coalesce("last", F.lit(0)) + place).cast("int").alias("rank")))
    named = words.join(chunks.select("id", "doc_id"), "id") if long else None
    if long:
        members = members.unionByName(fusion.first_of_documents(named).select("qid", "id"))
    scored = fusion.weighted_rrf(words, ranks, alpha, allow=members)
    if o.hops or o.signals:
        far = table(walk.query_hops(first_hits(near, words, 3).select("qid", "id"), every.distinct(), edges))
        if o.hops:
            scored = fusion.hop_prior(scored, far, o.missing)
        if o.signals:
            held = topology.cohesion(chunks, edges).select("basin_id", "cohesion")
            scored = scored.join(far, ["qid", "id"], "left").join(chunks.select("id", "basin_id"), "id", "left").join(held, "basin_id", "left")
            none = F.lit(None).cast("double")
            scored = fusion.signal_rank(scored.withColumns({"centrality": none, "memory": none})).select("qid", "id", "score")
    if o.gate:
        best = lambda x, c: x.groupBy("qid").agg(F.max("score").alias(c))
        both = best(near, "dense_score").join(best(words, "bm25_score"), "qid", "full_outer")
        scored = scored.join(fusion.confidence_gate(both).select("qid"), "qid", "left_semi")
    if not long:
        return Arms(index, words, near, fusion.ranked(scored, o.k))
    order = fusion.diversify(fusion.ranked(scored).join(chunks.select("id", "doc_id"), "id"), o.k)
    return Arms(index, words, near, fusion.rescue(order.select("qid", "id", "doc_id", "rank"), named, near, o.k))
