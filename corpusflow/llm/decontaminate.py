"""7. Benchmark decontamination with a positional inverted index.

``build_index`` stores the postings of the training documents (row, position, term) as a table in the shared folder; only
terms that some test item has are kept, since no other list is ever read.  A test item's windows are phrases of 8
consecutive words (the whole item where it is shorter).  For each window the two rarest terms are looked up first: their
lists, shifted by the term's place in the item, are intersected on (row, item, shift).  Only alignments that survive are
checked against the other terms' lists, and runs of enough consecutive matches are the exact occurrences.
``proximity_matches`` relaxes the shift by a slop.

DataFrame functions only.  Terms are never a shuffle key, so a frequent term is no hot group; counts are pre-aggregated.
The test vocabulary and the candidate rows are broadcast only where a count shows them small, otherwise the joins shuffle.

Defined results: null or empty texts have no words (and get a row of zeros); very long texts are indexed whole; rows that repeat a doc_id are documents of
their own, as are null doc_ids; an item id that is repeated counts once; items without an id or without words match nothing;
an empty test table leaves every document clean; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Everything up to DEL that is no digit and no lower-case letter separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
#: Above these counts, joins shuffle instead of broadcasting.
MOST_TERMS = 1_000_000
MOST_ROWS = 1_000_000


def words(column) -> F.Column:
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(column, F.lit(""))), GAP), "")


def test_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, ipos, term, n): the words of each test item; repeated item ids keep every text."""
    rows = items.filter(F.col(f"`{item_id}`").isNotNull()).select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{text}`").cast("string")).alias("ws"))
    rows = rows.distinct().withColumn("txt", F.xxhash64("ws"))
    return rows.select("item", "txt", F.size("ws").alias("n"), F.posexplode("ws").alias("ipos", "term"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings and read them back: row, doc_id, pos, term.

    Each document closes with a posting of the empty term at the position after its last word; only that one has the doc_id.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`").cast("string")).alias("ws"))
    tokens = rows.select("row", "doc_id", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "term"))
    if vocabulary is not None:
        terms = vocabulary.select("term").union(vocabulary.sparkSession.sql("select '' as term")).distinct()
        tokens = tokens.join(common.broadcast_if_small(terms, MOST_TERMS), "term", "left_semi")
    kept = tokens.select("row", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"), "pos", "term")
    return common.materialize(kept, "postings")


def windows(terms: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each window of each item with its terms from the rarest on; windows with a term that no document has are left out."""
    rated = terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    k = F.least(F.lit(size), F.col("n"))
    spread = rated.withColumn("k", k).select("item", "txt", "n", "k", "ipos", "term", "count", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("k") + 1), F.least(F.col("ipos"), F.col("n") - F.col("k")))).alias("start"))
    grouped = spread.groupBy("item", "txt", "start", "k").agg(F.array_sort(F.collect_list(F.struct("count", "ipos", "term"))).alias("by"))
    return grouped.filter(F.col("by")[0]["count"] > 0)


def alignments(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(row, item, txt, shift) where the two rarest terms of some window stand at the right distance."""
    pairs = wins.select("item", "txt", F.col("by")[0].alias("a"), F.element_at("by", F.least(F.lit(2), F.size("by"))).alias("b"))
    anchors = pairs.select("item", "txt", F.explode(F.array("a", "b")).alias("x")).select("item", "txt", "x.ipos", "x.term").distinct()
    wanted = pairs.groupBy("item", "txt").agg(F.collect_set(F.struct(F.col("a.ipos").alias("a"), F.col("b.ipos").alias("b"))).alias("wanted"))
    lists = index.filter(F.col("term") != "").join(common.broadcast_if_small(anchors, MOST_TERMS), "term")
    met = lists.groupBy("row", "item", "txt", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("met"))
    met = met.join(common.broadcast_if_small(wanted, MOST_TERMS), ["item", "txt"])
    both = F.exists("wanted", lambda p: F.array_contains("met", p["a"]) & F.array_contains("met", p["b"]))
    return met.filter(both).select("row", "item", "txt", "shift")


def phrase_matches(index: DataFrame, terms: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exact occurrences: row, item, begin, end (word positions, end exclusive); overlapping windows come as one run."""
    terms = common.materialize(terms, "terms")
    counts = index.groupBy("term").count()
    wins = common.materialize(windows(terms, counts, size), "windows")
    found = common.materialize(alignments(index, wins), "alignments")
    rows = common.broadcast_if_small(found.select("row").distinct(), MOST_ROWS)
    lists = index.filter(F.col("term") != "").join(rows, "row", "left_semi").select("row", "pos", "term")
    expected = found.join(common.broadcast_if_small(terms, MOST_TERMS), ["item", "txt"]).withColumn("pos", F.col("shift") + F.col("ipos"))
    met = expected.join(lists, ["row", "pos", "term"]).select("row", "item", "txt", "shift", "n", "ipos").distinct()
    by = Window.partitionBy("row", "item", "txt", "shift").orderBy("ipos")
    runs = met.withColumn("run", F.col("ipos") - F.row_number().over(by)).groupBy("row", "item", "txt", "shift", "n", "run").agg(F.count("*").alias("long"), F.min("ipos").alias("first"))
    return runs.filter(F.col("long") >= F.least(F.lit(size), F.col("n"))).select(
        "row", "item", (F.col("shift") + F.col("first")).alias("begin"), (F.col("shift") + F.col("first") + F.col("long")).cast("int").alias("end")
    )


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int = 3, size: int = WINDOW) -> DataFrame:
    """Rows and items where every term of some window stands within ``slop`` words of its place: row, item, begin."""
    terms = common.materialize(terms, "terms")
    wins = common.materialize(windows(terms, index.groupBy("term").count(), size), "windows")
    rare = wins.select("item", "txt", "start", "k", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["ipos"].alias("ipos"))
    lists = index.filter(F.col("term") != "").select("row", "pos", "term")
    begun = lists.join(common.broadcast_if_small(rare, MOST_TERMS), "term").select("row", "item", "txt", "start", "k", (F.col("pos") - F.col("ipos") + F.col("start")).alias("begin"))
    need = wins.select("item", "txt", "start", F.explode("by").alias("x")).select("item", "txt", "start", "x.ipos", "x.term")
    expected = begun.join(common.broadcast_if_small(need, MOST_TERMS), ["item", "txt", "start"]).withColumn("at", F.col("begin") + F.col("ipos") - F.col("start"))
    met = expected.join(lists, ["row", "term"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    whole = met.groupBy("row", "item", "txt", "start", "k", "begin").agg(F.count_distinct("ipos").alias("have")).filter(F.col("have") == F.col("k"))
    return whole.select("row", "item", "begin").distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most_items: int = 1) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside occurrences), items (sorted ids), contaminated (more than ``most_items``)."""
    terms = common.materialize(test_terms(items, item_id, item_text), "items")
    index = build_index(docs, terms, doc_id, text)
    found = common.materialize(phrase_matches(index, terms, size), "phrases")
    hits = found.select("row", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    by = found.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    whole = index.filter(F.col("term") == "").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = whole.join(hits.join(by, "row"), "row", "left").withColumn("items", F.coalesce("items", none))
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", (F.size("items") > most_items).alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT least(8, len(ws)) AS k FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, least(8, len(ws)) AS k, array_to_string(list_slice(ws, i + 1, i + least(8, len(ws))), ' ') AS gram
        FROM (SELECT item_id, ws, unnest(range(0, len(ws) - least(8, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i + 1, i + k), ' ') AS gram
      FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM d, k WHERE len(ws) >= k)),
m AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.gram = win.gram AND g.k = win.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""
}

QUERIES = {"op7_decontaminate": op7_decontaminate}
