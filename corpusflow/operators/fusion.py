"""Fusion and ranking of hits: (qid, id, ..., rank from 1).  Every order has an explicit tie key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K, DEPTH = 60, 500
ALPHA_FLAT, ALPHA_LONG = 0.15, 0.40


def weighted_rrf(lexical: DataFrame, dense: DataFrame, alpha: float = ALPHA_FLAT, k: int = RRF_K, depth: int = DEPTH, allow: DataFrame | None = None) -> DataFrame:
    """qid, id, score: alpha and 1 - alpha over (k + rank), lists cut at ``depth``.

    With ``allow`` (qid, id), lexical hits outside it are dropped after ranking, so they still use up their rank.
    """
    a = lexical.filter(F.col("rank") <= depth)
    if allow is not None:
        a = a.join(allow.select("qid", "id").distinct(), ["qid", "id"], "left_semi")
    a = a.select("qid", "id", (F.lit(alpha) / (k + F.col("rank"))).alias("part"))
    b = dense.filter(F.col("rank") <= depth).select("qid", "id", (F.lit(1.0 - alpha) / (k + F.col("rank"))).alias("part"))
    return a.unionByName(b).groupBy("qid", "id").agg(F.round(F.sum("part"), 8).alias("score"))


def ranked(scored: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "id")))
    return out if k is None else out.filter(F.col("rank") <= k)


def hop_prior(scored: DataFrame, hops: DataFrame, missing: str = "neutral") -> DataFrame:
    """Scores times 0.7 + 0.3 exp(-0.35 h); unreached nodes count as h = 0, or with ``penalty`` as the farthest plus 1."""
    out = scored.join(hops.select("qid", "id", "hop"), ["qid", "id"], "left")
    far = F.lit(0) if missing == "neutral" else F.coalesce(F.max("hop").over(Window.partitionBy("qid")), F.lit(0)) + 1
    h = F.coalesce("hop", far)
    return out.withColumn("score", F.round(F.col("score") * (0.7 + 0.3 * F.exp(-0.35 * h)), 8)).drop("hop")


def signal_rank(scored: DataFrame) -> DataFrame:
    """Several signals (score, and hop, cohesion, centrality, memory, each may be null) averaged over those present, braked."""
    base = F.col("score") / F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(1e-12))
    parts = [(0.40, base), (0.20, F.exp(-0.35 * F.col("hop"))), (0.15, F.col("cohesion")), (0.15, F.col("centrality")), (0.10, F.col("memory"))]
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts[1:]), F.lit(parts[0][0]))
    total = sum((F.coalesce(w * c, F.lit(0.0)) for w, c in parts[1:]), parts[0][0] * base)
    return scored.withColumn("score", F.round(0.5 + 0.5 * F.tanh(total / weight - 0.5), 8))


def first_of_documents(hits: DataFrame, most: int = 10) -> DataFrame:
    """The first node of each of the first ``most`` documents: hits need doc_id."""
    w = Window.partitionBy("qid", "doc_id").orderBy("rank")
    firsts = hits.filter("doc_id is not null").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("place") <= most)


def collapse(hits: DataFrame) -> DataFrame:
    """Documents in the order of their first hit: qid, doc_id, rank."""
    first = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("first"))
    return first.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("first", "doc_id")).alias("rank"))


def diversify(hits: DataFrame, k: int) -> DataFrame:
    """Documents by their best score, their chunks in turn: chunk number first, then the document's place."""
    chunk = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))
    out = hits.withColumn("__c", chunk).withColumn("__best", F.max("score").over(Window.partitionBy("qid", "doc_id"))).withColumn("__first", F.min("rank").over(Window.partitionBy("qid", "doc_id")))
    # a dense rank would merge documents of one score: the first hit's rank tells them apart
    w = Window.partitionBy("qid").orderBy("__c", F.desc("__best"), "__first")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__c", "__best", "__first")


def rescue(order: DataFrame, lexical: DataFrame, dense: DataFrame, k: int, most: int = 2, head: int = 80, slot: int = 2) -> DataFrame:
    """Splice the first lexical hits of documents that the order lacks in at place ``slot``; the tail goes."""
    order = order.filter(F.col("rank") <= k)
    seen = order.select("qid", "doc_id").distinct()
    new = lexical.filter(F.col("rank") <= head).join(dense.select("qid", "id"), ["qid", "id"], "left_anti").join(seen, ["qid", "doc_id"], "left_anti").filter("doc_id is not null")
    extra = first_of_documents(new, most).select("qid", "id", "doc_id", F.col("place").alias("extra"))
    n = extra.groupBy("qid").agg(F.max("extra").alias("n"))
    at = F.least(F.lit(slot), F.greatest(F.lit(0), F.lit(k) - F.col("n")))
    kept = order.join(n, "qid", "left").select("qid", "id", "doc_id", F.when(F.col("n").isNull() | (F.col("rank") <= at), F.col("rank")).otherwise(F.col("rank") + F.col("n")).alias("rank"))
    put = extra.join(n, "qid").select("qid", "id", "doc_id", (at + F.col("extra")).alias("rank"))
    return kept.unionByName(put).filter(F.col("rank") <= k)


def confidence_gate(hits: DataFrame, dense: float = 0.15, lexical: float = 0.5) -> DataFrame:
    """Nothing for queries whose best dense and best lexical scores are both low: hits need dense_score, bm25_score."""
    w = Window.partitionBy("qid")
    low = (F.coalesce(F.max("dense_score").over(w), F.lit(0.0)) < dense) & (F.coalesce(F.max("bm25_score").over(w), F.lit(0.0)) < lexical)
    return hits.withColumn("__low", low).filter(~F.col("__low")).drop("__low")


def normalized(hits: DataFrame) -> DataFrame:
    return hits.withColumn("normal", F.round(F.col("score") / (F.max("score").over(Window.partitionBy("qid")) + 1e-6), 6))


def rerank_head(hits: DataFrame, k: int, head: int = 25) -> DataFrame:
    """The first max(head, k) hits by ``rerank_score`` then id; the others keep their order behind them."""
    most = max(head, k)
    inside = F.col("rank") <= most
    w = Window.partitionBy("qid").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, -F.col("rerank_score")).otherwise(F.col("rank")), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tail_scores(hits: DataFrame) -> DataFrame:
    """Scores for a leaderboard: reranked heads keep theirs, others stand under the least of them in their own order."""
    w = Window.partitionBy("qid")
    normal = F.col("score") / (F.max("score").over(w) + 1e-6)
    low = F.coalesce(F.min("rerank_score").over(w), F.lit(1.0))
    tail = 0.95 * low * (0.5 * normal + 0.5 / (1 + 0.003 * (F.col("rank") - 1)))
    return hits.withColumn("final", F.round(F.coalesce("rerank_score", tail), 8))


def run_export(hits: DataFrame, k: int) -> DataFrame:
    """One score a document for an evaluation run, from the first 2k hits: 1 / rank where a hit has none."""
    first = hits.filter(F.col("rank") <= 2 * k).groupBy("qid", "doc_id").agg(F.min("rank").alias("r"), F.min_by("score", "rank").alias("s"))
    out = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("r", "doc_id"))).filter(F.col("n") <= k)
    return out.select("qid", "doc_id", F.coalesce("s", 1.0 / F.col("r")).alias("score"))
