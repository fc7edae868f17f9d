"""Queries of the text, lexical, vector, fusion and metric operators over the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dense, fusion, lexical, metrics, passages
from ..operators.tables import table as cut
from . import oracle as O
from . import search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def batch(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def truths(spark, d) -> DataFrame:
    """Documents that hold a query's text."""
    return passages.holders(docs(spark, d), batch(spark, d)).select("qid", F.col("id").alias("doc_id"))


def tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return docs(spark, d).select("id", t.alias("t")).select(F.col("id").alias("doc_id"), F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def languages(spark, d):
    rows = docs(spark, d).select("id", "text", X.tokens(F.col("text")).alias("toks"))
    return rows.select(F.col("id").alias("doc_id"), X.language(F.col("text"), F.col("toks")).alias("language"))


def stopwords(spark, d):
    return lexical.term_lists(docs(spark, d)).select(F.col("id").alias("doc_id"), F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("digest"))


def keywords_of(rows: DataFrame, key: list[str], n: int = 8) -> DataFrame:
    from pyspark.sql.window import Window

    each = rows.select(*key, F.posexplode(X.keyword_tokens(F.col("toks"))).alias("pos", "term")).groupBy(*key, "term").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("c"), "first"))).filter(F.col("r") <= n)
    return top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("keywords"))


def layers(spark, d):
    rows = docs(spark, d).select("id", "text", X.tokens(F.col("text")).alias("toks"))
    first = rows.select("id", X.first_sentence(F.col("text")).alias("sentence"))
    return first.join(keywords_of(rows, ["id"]), "id", "left").select(F.col("id").alias("doc_id"), "sentence", F.coalesce("keywords", F.lit("")).alias("keywords"))


def node_ids(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", X.node_id(F.col("source"), F.lit(0), F.col("text")).alias("node_id"))


def estimates(spark, d):
    t = table(spark, d, "conversations")
    c = F.col("text")
    return t.select("conv_id", "turn", X.briefing_tokens(c).cast("long").alias("briefing"), X.prompt_tokens(c).cast("long").alias("prompt"), X.word_count(c).cast("long").alias("words"), X.capped(c, 60).alias("capped"), X.title_and_text(F.col("role"), c).alias("titled"), X.escaped(c).alias("escaped"))


def scalars(spark, d):
    e = table(spark, d, "events")
    v = F.col("value")
    return e.select("event_id", F.round(X.soft_brake(v / 100), 6).alias("braked"), X.candidate_pool((F.col("user_id") % 60 + 1).cast("int"), F.col("user_id") % 2 == 0).cast("long").alias("pool"), X.is_revision(F.sha1(F.col("event_type"))).alias("revision"), X.is_test_path(F.concat(F.lit("src/"), F.col("event_type"), F.when(F.col("user_id") % 3 == 0, "_test.py").otherwise(".py"))).alias("test_path"), X.repo_path(F.concat(F.lit(".\\a\\"), F.col("event_type"))).alias("path"))


def evidence(spark, d):
    return passages.evidence(docs(spark, d), batch(spark, d)).select(F.col("id").alias("doc_id"), "qid")


def term_statistics(spark, d):
    index = lexical.build_index(docs(spark, d))
    return index.terms.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def bm25(spark, d):
    index = lexical.build_index(docs(spark, d))
    return lexical.bm25(index, batch(spark, d), 50).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def feedback(spark, d):
    index = lexical.build_index(docs(spark, d))
    q = batch(spark, d)
    out = lexical.expansion_terms(index, q, lexical.bm25(index, q, 10), docs(spark, d))
    return out.select("qid", "term", F.col("place").cast("long").alias("place"))


def two_passes(spark, d):
    index = lexical.build_index(docs(spark, d))
    q = batch(spark, d)
    first = lexical.bm25(index, q, 20)
    second = lexical.bm25(index, lexical.expanded(q, lexical.expansion_terms(index, q, first, docs(spark, d))), 20)
    return lexical.union_passes(first, second).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def dense_arm(spark, d):
    index = lexical.build_index(docs(spark, d))
    return dense.hashed_top_k(index, search.query_vectors(index, batch(spark, d)), 50).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def vector_top_k(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    return dense.exact_top_k(e, q, 10).select("qid", F.col("id").alias("vec_id"), "score")


def hybrid(spark, d):
    return search.flat_hybrid(docs(spark, d), batch(spark, d)).hybrid.select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def _runs(arms: search.Arms):
    return {k: v.withColumnRenamed("id", "doc_id") for k, v in (("bm25", arms.bm25), ("dense", arms.dense), ("hybrid", arms.hybrid))}


def ranking_metrics(spark, d):
    runs = _runs(search.flat_hybrid(docs(spark, d), batch(spark, d)))
    rel = cut(truths(spark, d))
    out = None
    for name, run in runs.items():
        one = metrics.summary(metrics.per_query(run, rel)).withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def query_metrics(spark, d):
    index = lexical.build_index(docs(spark, d))
    run = lexical.bm25(index, batch(spark, d), 10).withColumnRenamed("id", "doc_id")
    return metrics.per_query(run, cut(truths(spark, d)))


def metric_grid(spark, d):
    index = lexical.build_index(docs(spark, d))
    run = lexical.bm25(index, batch(spark, d), 10).withColumnRenamed("id", "doc_id")
    return metrics.grid(run, cut(truths(spark, d))).withColumn("k", F.col("k").cast("long"))


def stage_audit(spark, d):
    runs = _runs(search.flat_hybrid(docs(spark, d), batch(spark, d)))
    out = metrics.stage_losses(list(runs.items()), cut(truths(spark, d)))
    return out.groupBy("drop_at").agg(F.count("*").alias("queries"))


QUERIES = {
    "text_tokenize": tokenize, "text_language": languages, "text_stopwords": stopwords, "text_layers": layers, "text_node_id": node_ids, "text_estimates": estimates,
    "text_scalars": scalars, "text_evidence": evidence, "lexical_term_statistics": term_statistics, "lexical_bm25": bm25, "lexical_feedback": feedback, "lexical_two_passes": two_passes,
    "dense_hashed": dense_arm, "dense_embeddings": vector_top_k, "hybrid_flat": hybrid, "metrics_summary": ranking_metrics, "metrics_per_query": query_metrics,
    "metrics_grid": metric_grid, "metrics_stage_audit": stage_audit,
}

_T = f"t AS (SELECT doc_id, text, {O.TOKENS} AS toks FROM documents)"
_FB = f"""{O.INDEX}, {O.QUERIES}, {{bm}},
modal AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
ql AS (SELECT qid, toks, coalesce(lang, (SELECT lang FROM modal), 'pt') AS lang FROM q_l),
qown AS (SELECT DISTINCT qid, unnest({O.KEPT}) AS term FROM ql),
fbt AS (SELECT bm.qid, ql.lang, d_t.toks FROM bm JOIN d_t ON bm.id = d_t.id JOIN ql ON ql.qid = bm.qid WHERE rank <= 3),
fbx AS (SELECT qid, unnest({O.KEPT}) AS term FROM fbt),
fbc AS (SELECT qid, term, round(count(*) * max(idf), 6) AS w FROM fbx JOIN tstat USING (term) WHERE length(term) >= 3 AND (qid, term) NOT IN (SELECT (qid, term) FROM qown) GROUP BY qid, term),
fb AS (SELECT qid, term, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, term DESC) AS place FROM fbc) WHERE place <= 8)"""


def _metrics(run: str, k: int = 10) -> str:
    return f"""SELECT size.qid, round(coalesce(1.0 / min(rank), 0), 6) AS mrr,
      round(coalesce(sum(1.0 / log2(rank + 1)) / max(ideal), 0), 6) AS ndcg, CASE WHEN min(rank) IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit,
      round(count(DISTINCT h.id)::DOUBLE / max(n), 6) AS recall
      FROM (SELECT qid, count(*) AS n, list_sum(list_transform(range(1, least({k}, count(*)) + 1), lambda i: 1.0 / log2(i + 1))) AS ideal FROM rel GROUP BY qid) size
      LEFT JOIN (SELECT {run}.* FROM {run} JOIN rel ON rel.qid = {run}.qid AND rel.doc_id = {run}.id WHERE rank <= {k}) h USING (qid) GROUP BY size.qid"""


_CJK = "[一-鿿぀-ゟ゠-ヿ가-힯]"
_EV = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2))"
ORACLE_SQL = {
    "text_tokenize": f"WITH {_T} SELECT doc_id, len(toks)::BIGINT AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM t",
    "text_language": f"WITH {_T} SELECT doc_id, {O.LANGUAGE} AS language FROM t",
    "text_stopwords": f"WITH {O.lists('d', 'documents', 'doc_id')} SELECT doc_id, len(terms)::BIGINT AS n_terms, md5(array_to_string(terms, ' ')) AS digest FROM d",
    "text_layers": f"""WITH {_T}, k AS (SELECT doc_id, unnest({O.KEYWORDS}) AS term, generate_subscripts({O.KEYWORDS}, 1) AS pos FROM t),
c AS (SELECT doc_id, term, count(*) AS c, min(pos) AS first FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first) AS r FROM c),
w AS (SELECT doc_id, string_agg(term, ', ' ORDER BY r) AS keywords FROM r WHERE r <= 8 GROUP BY doc_id),
s AS (SELECT doc_id, trim(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1]) AS s FROM documents)
SELECT s.doc_id, CASE WHEN length(s) > 280 THEN substr(s, 1, 279) || '…' ELSE s END AS sentence, coalesce(keywords, '') AS keywords FROM s LEFT JOIN w USING (doc_id)""",
    "text_node_id": "SELECT doc_id, substr(sha256(source || chr(0) || '0' || chr(0) || text), 1, 24) AS node_id FROM documents",
    "text_estimates": f"""WITH e AS (SELECT *, length(regexp_replace(text, '[^' || '{_CJK[1:-1]}' || ']', '', 'g')) AS cjk, regexp_replace(text, '{_CJK}', '', 'g') AS plain FROM conversations)
SELECT conv_id, turn, (cjk + (length(regexp_replace(plain, '\\s', '', 'g')) + 1) // 2)::BIGINT AS briefing,
CASE WHEN text = '' THEN 0 ELSE greatest(1, cjk + ceil(length(regexp_replace(plain, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) / 2.5) + ceil(length(regexp_replace(plain, '[\\p{{L}}\\p{{N}}_\\s]', '', 'g')) / 2)) END::BIGINT AS prompt,
len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words,
regexp_replace(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 60), '\\s+$', '') AS capped, trim(role) || ' ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS titled,
replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM e""",
    "text_scalars": """SELECT event_id, round(0.5 + 0.5 * tanh(value / 100 - 0.5), 6) AS braked,
CASE WHEN user_id % 2 = 0 THEN greatest(200, 10 * (user_id % 60 + 1)) ELSE greatest(50, 5 * (user_id % 60 + 1)) END::BIGINT AS pool, true AS revision,
len(list_intersect(regexp_split_to_array(lower('src/' || event_type || CASE WHEN user_id % 3 = 0 THEN '_test.py' ELSE '.py' END), '[ _/.]'), ['test', 'tests', 'testing'])) > 0 AS test_path,
'a/' || event_type AS path FROM events""",
    "text_evidence": f"""WITH a AS (SELECT doc_id, {_EV} AS a FROM documents), b AS (SELECT item_id AS qid, {_EV} AS b FROM benchmark),
m AS (SELECT doc_id, qid, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS met FROM a, b)
SELECT doc_id, qid FROM m WHERE na > 0 AND nb > 0 AND (met >= 0.15 * (na + nb - met) OR met >= 0.5 * nb)""",
    "lexical_term_statistics": f"WITH {O.INDEX} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM tstat",
    "lexical_bm25": f"WITH {O.INDEX}, {O.QUERIES}, {O.bm25(50)} SELECT qid, id AS doc_id, score, rank FROM bm",
    "lexical_feedback": f"WITH {_FB.format(bm=O.bm25(10))} SELECT qid, term, place FROM fb",
    "lexical_two_passes": f"""WITH {_FB.format(bm=O.bm25(20))}, more AS (SELECT qid, string_agg(term, ' ' ORDER BY place) AS more FROM fb GROUP BY qid),
q2src AS (SELECT item_id AS qid, text || coalesce(' ' || more, '') AS text FROM benchmark LEFT JOIN more ON more.qid = item_id),
{O.lists('q2', 'q2src', 'qid')}, qt2 AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(terms) AS term FROM q2) GROUP BY ALL), {O.bm25(20, 'qt2', 'bm2')},
u AS (SELECT *, 0 AS p FROM bm UNION ALL SELECT *, 1 FROM bm2), f AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 8) AS fused, arg_min(score, p) AS score FROM u GROUP BY ALL)
SELECT qid, id AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM f""",
    "dense_hashed": f"WITH {O.INDEX}, {O.QUERIES}, {O.dense(50)} SELECT qid, id AS doc_id, score, rank FROM dn_top",
    "dense_embeddings": """WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS r FROM s) SELECT qid, vec_id, s AS score FROM r WHERE r <= 10 AND (s >= 0.05 OR r = 1)""",
    "hybrid_flat": f"WITH {O.FLAT} SELECT qid, id AS doc_id, score, rank FROM hy",
    "metrics_summary": f"WITH {O.FLAT}, {O.QRELS} " + " UNION ALL ".join(f"SELECT '{n}' AS arm, count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall FROM ({_metrics(r)})" for n, r in (("bm25", "bm"), ("dense", "dn_top"), ("hybrid", "hy"))),
    "metrics_per_query": f"WITH {O.INDEX}, {O.QUERIES}, {O.bm25(10)}, {O.QRELS} {_metrics('bm')}",
    "metrics_grid": f"""WITH {O.INDEX}, {O.QUERIES}, {O.bm25(10)}, {O.QRELS}, ks AS (SELECT unnest([1, 5, 10]) AS k), size AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
h AS (SELECT bm.qid, rank, row_number() OVER (PARTITION BY bm.qid ORDER BY rank) AS nth FROM bm JOIN rel ON rel.qid = bm.qid AND rel.doc_id = bm.id),
g AS (SELECT qid, k, min(rank) AS first, sum(1.0 / log2(rank + 1)) AS dcg, sum(nth / rank) AS ap, count(*) AS found FROM h, ks WHERE rank <= k GROUP BY ALL),
a AS (SELECT size.qid, ks.k, n, list_sum(list_transform(range(1, least(ks.k, n) + 1), lambda i: 1.0 / log2(i + 1))) AS ideal, first, dcg, ap, found FROM size CROSS JOIN ks LEFT JOIN g ON g.qid = size.qid AND g.k = ks.k)
SELECT k::BIGINT AS k, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg, round(avg(coalesce(ap / n, 0)), 6) AS map, round(avg(coalesce(found / n, 0)), 6) AS recall, round(avg(coalesce(found / k, 0)), 6) AS precision, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM a GROUP BY k""",
    "metrics_stage_audit": f"""WITH {O.FLAT}, {O.QRELS}, h AS (SELECT DISTINCT qid, EXISTS (SELECT 1 FROM bm JOIN rel r ON r.qid = bm.qid AND r.doc_id = bm.id WHERE bm.qid = rel.qid AND rank <= 10) AS a,
EXISTS (SELECT 1 FROM dn_top JOIN rel r ON r.qid = dn_top.qid AND r.doc_id = dn_top.id WHERE dn_top.qid = rel.qid AND rank <= 10) AS b, EXISTS (SELECT 1 FROM hy JOIN rel r ON r.qid = hy.qid AND r.doc_id = hy.id WHERE hy.qid = rel.qid AND rank <= 10) AS c FROM rel)
SELECT CASE WHEN a AND NOT b THEN 'dense' WHEN b AND NOT c THEN 'hybrid' WHEN NOT (a OR b OR c) THEN 'never' ELSE 'none' END AS drop_at, count(*) AS queries FROM h GROUP BY 1""",
}
