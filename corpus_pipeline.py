"""A corpus in five stages: toxicity, near-duplicates, benchmark decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.

Defined results: null and empty texts pass the first four stages unless they are rejected (an empty text is linked with
nothing, has no words, and no secrets) and get no tokens; very long texts pass whole; a repeated row is a document of its own in each stage; an
empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bpe, common, decontaminate, neardup, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.  It learns from the labelled documents of the whole table."""
    whole = common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    model = toxicity.train(whole, common.table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs.withColumnsRenamed({c: f"{c}__own" for c in ("score", "predicted") if c in docs.columns}), model)
    kept = scored.filter("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({f"{c}__own": c for c in ("score", "predicted")}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"), most_items=0)
    gone = found.filter("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text becomes its kind in brackets; the document stays."""
    clash = {c: f"{c}__own" for c in ("base", "spans") if c in docs.columns}
    found = secrets.scan(docs.withColumnsRenamed(clash))
    text = F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("base", "spans").withColumnsRenamed({b: a for a, b in clash.items()}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: their number and digests of the ids and of the text that they decode to."""
    out = bpe.bpe_encode(common.narrow(docs, ["doc_id", "text"]))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Boosted trees, components and merges can't be said in SQL: the tests hold the pipeline against its parts in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
