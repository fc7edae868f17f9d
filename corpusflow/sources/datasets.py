"""Retrieval datasets as corpus, queries and truths: JSON lines, nested papers, question answering, patches, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def json_documents(records: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """source, text, question, answer from records (n, documents: array of strings, question, answer).

    ``n`` orders the records and ``limit`` counts them; blank documents are skipped and the source's number counts the others.
    """
    if dict(records.dtypes)["documents"] == "string":
        records = records.withColumn("documents", F.array("documents"))
    rows = records if limit is None else records.withColumn("__r", F.row_number().over(Window.orderBy("n"))).filter(F.col("__r") <= limit)
    each = rows.select("n", "question", "answer", F.posexplode("documents").alias("p", "text")).filter(X.strip(F.coalesce("text", F.lit(""))) != "")
    # numbering over the whole input: counts a slice of records, then a place in the slice
    cut = each.withColumn("slice", F.floor(F.col("n") / 10_000))
    before = cut.groupBy("slice").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = cut.withColumn("i", F.row_number().over(Window.partitionBy("slice").orderBy("n", "p"))).join(before, "slice")
    return placed.select(F.concat(F.lit(f"{path}#"), (F.col("before") + F.col("i") - 1).cast("string")).alias("source"), "text", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


def beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, text), queries (qid, text), qrels (qid, doc_id) with a positive score; broken lines are left out."""
    c = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    q = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    r = spark.read.option("sep", "\t").option("header", "true").schema("qid string, doc_id string, score string").csv(f"{folder}/qrels/{split}.tsv")
    corpus = c.filter("_id is not null").select(F.col("_id").alias("doc_id"), X.strip(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))
    return corpus, q.filter("_id is not null").select(F.col("_id").alias("qid"), "text"), r.filter(F.expr("try_cast(score as int)") > 0).select("qid", "doc_id").distinct()


def squad(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corpus (doc_id, title, text), queries (qid, query, doc_id, answers) from articles (title, paragraphs)."""
    para = articles.select("title", F.posexplode("paragraphs").alias("i", "p")).select(F.concat_ws("_", "title", "i").alias("doc_id"), "title", "p")
    asked = para.select("doc_id", F.explode("p.qas").alias("qa"))
    return para.select("doc_id", "title", F.col("p.context").alias("text")), asked.select(F.col("qa.id").alias("qid"), F.col("qa.question").alias("query"), "doc_id", F.col("qa.answers.text").alias("answers"))


def papers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corpus (doc_id, text), queries (qid, text, doc_id) from nested papers.

    rows: id, title, abstract, full_text (section_name: array, paragraphs: array of arrays), qas (question, question_id).
    """
    no = F.array().cast("array<string>")
    body = lambda ps: F.array_join(F.filter(F.coalesce(ps, no), lambda p: p != ""), "\n")
    pairs = F.arrays_zip(F.col("full_text.section_name").alias("name"), F.col("full_text.paragraphs").alias("ps"))
    named = lambda s: F.when(F.coalesce(s["name"], F.lit("")) != "", F.concat(F.lit("## "), s["name"], F.lit("\n"), body(s["ps"]))).otherwise(body(s["ps"]))
    sections = F.transform(F.filter(pairs, lambda s: X.strip(body(s["ps"])) != ""), named)
    parts = F.concat(F.array(X.title_and_text(F.col("title"), F.col("abstract"))), F.coalesce(sections, no))
    corpus = rows.select(F.col("id").alias("doc_id"), F.array_join(F.filter(parts, lambda p: X.strip(p) != ""), "\n\n").alias("text"), "qas").filter(X.strip(F.col("text")) != "")
    asked = corpus.select("doc_id", "qas.question_id", F.posexplode("qas.question").alias("i", "text")).filter(F.coalesce("text", F.lit("")) != "")
    own = F.nullif(F.get("question_id", F.col("i")), F.lit(""))
    return corpus.select("doc_id", "text"), asked.select(F.coalesce(own, F.concat("doc_id", F.lit("-q"), F.col("i").cast("string"))).alias("qid"), "text", "doc_id")


def paper_evidence(rows: DataFrame) -> DataFrame:
    """qid, gold: evidence and highlighted evidence of all answers, each once.  rows: id, qas (question, question_id, answers)."""
    each = rows.select("id", F.posexplode("qas.question").alias("i", "q"), "qas.question_id", "qas.answers")
    qid = F.coalesce(F.nullif(F.get("question_id", F.col("i")), F.lit("")), F.concat("id", F.lit("-q"), F.col("i").cast("string")))
    a = F.get("answers", F.col("i"))["answer"]
    gold = F.concat(F.flatten(F.coalesce(a["evidence"], F.array())), F.flatten(F.coalesce(a["highlighted_evidence"], F.array())))
    return each.select(qid.alias("qid"), F.explode(gold).alias("gold")).filter(X.strip(F.col("gold")) != "").distinct()


def long_papers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corpus (doc_id, text), queries (qid, text, doc_id): whole papers asked for by their abstracts.  rows: id, article, abstract."""
    t = rows.select("id", X.strip(F.coalesce("article", F.lit(""))).alias("article"), X.strip(F.coalesce("abstract", F.lit(""))).alias("abstract"))
    t = t.filter((F.length("article") >= 2000) & (F.length("abstract") >= 80))
    return t.select(F.col("id").alias("doc_id"), F.substring("article", 1, 40_000).alias("text")), t.select(F.concat("id", F.lit("-abs")).alias("qid"), F.col("abstract").alias("text"), F.col("id").alias("doc_id"))


def patch_instances(rows: DataFrame, per_repo: int | None = None) -> DataFrame:
    """instance_id, repo, gold (files that the patch changes), tests (names), of instances with a patch that changes files.

    rows: instance_id, repo, patch, FAIL_TO_PASS (a JSON list, or a list).
    """
    kind = dict(rows.dtypes)["FAIL_TO_PASS"]
    tests = F.col("FAIL_TO_PASS") if kind.startswith("array") else F.coalesce(F.from_json("FAIL_TO_PASS", "array<string>"), F.array().cast("array<string>"))
    out = rows.select("instance_id", "repo", X.patch_files(F.col("patch")).alias("gold"), tests.alias("tests")).filter(F.size("gold") > 0)
    if per_repo is None:
        return out
    w = Window.partitionBy("repo").orderBy("instance_id")
    return out.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_repo).drop("__r")


def result_files(spark: SparkSession, folder: str, tasks: list[str]) -> DataFrame:
    """task, split, main_score, path from result files: requested tasks only, the test split where there is one, else dev."""
    one = "array<struct<main_score: double>>"
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").schema(f"task_name string, scores struct<test: {one}, dev: {one}>").json(folder)
    best = rows.select(F.col("task_name").alias("task"), F.when(F.size("scores.test") > 0, "test").otherwise("dev").alias("split"), F.coalesce(F.get("scores.test", F.lit(0)), F.get("scores.dev", F.lit(0)))["main_score"].alias("main_score"), F.col("_metadata.file_path").alias("full"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    return best.filter(F.col("task").isin(tasks) & F.col("main_score").isNotNull()).select("task", "split", "main_score", F.substring_index("full", f"{root}/", -1).alias("path"))


def mini_corpus(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Eight documents and five queries with their truths, for a first look at a search."""
    docs = [
        "The tide tables of the harbour list high water for every day of the year.", "A sourdough starter needs flour, water and a warm corner of the kitchen.",
        "Basalt columns form when thick lava cools slowly and cracks into hexagons.", "The night train to the coast leaves from platform nine at a quarter past ten.",
        "Swallows return in April and build their nests of mud under the eaves.", "A violin's bridge carries the vibration of the strings to the belly.",
        "Terraced fields hold the rain so that rice can grow on steep slopes.", "The library lends maps, telescopes and sewing machines besides books.",
    ]
    asked = [("q1", "high water tide tables", "d0"), ("q2", "flour for a sourdough starter", "d1"), ("q3", "hexagons of cooled lava", "d2"), ("q4", "night train platform", "d3"), ("q5", "library telescopes", "d7")]
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(docs)], "id string, text string"), spark.createDataFrame(asked, "qid string, text string, doc_id string")
