"""Ranking metrics over runs (qid, doc_id, rank from 1) and truths (qid, doc_id); audits of what each stage loses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, mrr, ndcg, hit, recall at k for every query that has a truth; without results all are 0.

    A document that a run repeats gains each time; the ideal order has min(k, relevant) gains.
    """
    rel = qrels.select("qid", "doc_id").distinct()
    size = rel.groupBy("qid").agg(F.count("*").alias("rel"))
    hits = run.filter(F.col("rank") <= k).join(rel, ["qid", "doc_id"])
    got = hits.groupBy("qid").agg(F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.countDistinct("doc_id").alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = size.join(got, "qid", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("qid", z(1.0 / F.col("first")).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"), z(F.col("found") / F.col("rel")).alias("recall"))


def summary(each: DataFrame) -> DataFrame:
    return each.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("mrr", "ndcg", "hit", "recall")])


def grid(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """k, ndcg, map, recall, precision, mrr: means over all queries with a truth, for several cuts in one pass."""
    spark = run.sparkSession
    rel = qrels.select("qid", "doc_id").distinct()
    size = rel.groupBy("qid").agg(F.count("*").alias("rel"))
    cuts = spark.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hits = run.filter(F.col("rank") <= max(ks)).join(rel, ["qid", "doc_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    at = hits.join(F.broadcast(cuts), F.col("rank") <= F.col("k"))
    got = at.groupBy("qid", "k").agg(F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("ap"), F.count("*").alias("found"))
    whole = size.crossJoin(F.broadcast(cuts)).join(got, ["qid", "k"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("k"), F.col("rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    m = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(n)
    return whole.groupBy("k").agg(m(F.col("dcg") / ideal, "ndcg"), m(F.col("ap") / F.col("rel"), "map"), m(F.col("found") / F.col("rel"), "recall"), m(F.col("found") / F.col("k"), "precision"), m(1.0 / F.col("first"), "mrr"))


def stage_losses(stages: list[tuple[str, DataFrame]], qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, drop_at: the first stage that loses the hit the stage before had (``none`` if none does, ``never`` if no stage hits)."""
    rel = qrels.select("qid", "doc_id").distinct()
    out = rel.select("qid").distinct()
    for name, run in stages:
        hit = run.filter(F.col("rank") <= k).join(rel, ["qid", "doc_id"], "left_semi").select("qid").distinct().withColumn(name, F.lit(True))
        out = out.join(hit, "qid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    names = [n for n, _ in stages]
    lost = F.coalesce(*[F.when(F.col(a) & ~F.col(b), F.lit(b)) for a, b in zip(names, names[1:], strict=False)], F.lit(None)) if len(names) > 1 else F.lit(None)
    some = F.greatest(*[F.col(n).cast("int") for n in names]) if len(names) > 1 else F.col(names[0]).cast("int")
    return out.select("qid", *names, F.coalesce(lost, F.when(some == 0, "never"), F.lit("none")).alias("drop_at"))


def file_recall(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """qid, recall, any, all, mrr for ranked file paths; a README at the head of a run is passed over."""
    lead = F.when((F.col("rank") == 1) & F.lower("path").rlike("(^|/)readme[^/]*$"), 1).otherwise(0)
    w = Window.partitionBy("qid")
    moved = run.withColumn("skip", F.max(lead).over(w)).filter(~((F.col("rank") == 1) & (F.col("skip") == 1))).withColumn("rank", F.col("rank") - F.col("skip"))
    size = gold.distinct().groupBy("qid").agg(F.count("*").alias("n"))
    hit = moved.filter(F.col("rank") <= k).join(gold.distinct(), ["qid", "path"]).groupBy("qid").agg(F.countDistinct("path").alias("found"), F.min("rank").alias("first"))
    out = size.join(hit, "qid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select("qid", F.round(F.col("found") / F.col("n"), 6).alias("recall"), (F.col("found") > 0).alias("any"), (F.col("found") == F.col("n")).alias("all"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def gate_decision(control: float, control_reference: float, long_gain: float, hybrid: float, encoder: float, complete: bool = True) -> str:
    """The decision by thresholds fixed beforehand: an invalid gate first, then a gain on long documents, then near-parity."""
    if not complete or abs(control - control_reference) > 0.005:
        return "GATE_INVALID"
    return "CONTINUE_B" if long_gain >= 0.01 and hybrid >= encoder - 0.01 else "CONVERT_C"


def complete_mean(scores: DataFrame, tasks: int) -> DataFrame:
    """The mean of task scores, null unless every task is complete and none was sampled."""
    ok = (F.count("*") == tasks) & (F.min(F.col("complete").cast("int")) == 1) & (F.max(F.col("sampled").cast("int")) == 0)
    return scores.agg(F.when(ok, F.round(F.avg("score"), 6)).alias("mean"), F.count("*").alias("tasks"))


def passage_recall(run: DataFrame, evidence: DataFrame, k: int = 10) -> DataFrame:
    """qid, hit, covered: whether a passage among the first k overlaps a gold one, and the share of gold ones overlapped.

    run: qid, rank, text.  evidence: qid, gold.  The pairs compared are k x a query's own gold passages.
    """
    gold = evidence.select("qid", "gold").distinct().withColumn("g", X.evidence_tokens(F.col("gold")))
    top = run.filter(F.col("rank") <= k).select("qid", X.evidence_tokens(F.col("text")).alias("c"))
    met = gold.join(top, "qid", "left").withColumn("met", F.coalesce(X.evidence_hit(F.col("c"), F.col("g")), F.lit(False)))
    each = met.groupBy("qid", "gold").agg(F.max("met").alias("met"))
    return each.groupBy("qid").agg(F.max(F.col("met").cast("double")).alias("hit"), F.round(F.avg(F.col("met").cast("double")), 6).alias("covered"))


def head_to_head(rows: DataFrame) -> DataFrame:
    """system, hit, latency, build: means by system.  rows: system, qid, gold, found, latency, build; a found path may be longer."""
    norm = X.repo_path
    hit = F.when(norm(F.col("found")).endswith(norm(F.col("gold"))) | norm(F.col("gold")).endswith(norm(F.col("found"))), 1.0).otherwise(0.0)
    each = rows.groupBy("system", "qid").agg(F.max(F.coalesce(hit, F.lit(0.0))).alias("hit"), F.first("latency").alias("latency"), F.first("build").alias("build"))
    return each.groupBy("system").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("hit", "latency", "build")])


def resolved_share(results: DataFrame, total: int) -> DataFrame:
    """Resolved instances over the whole dataset, not over those handed in."""
    return results.agg(F.round(F.sum(F.col("resolved").cast("int")) / F.lit(total), 6).alias("resolved"), F.count("*").alias("submitted"))
