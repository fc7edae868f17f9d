"""From ranked hits to a briefing: routing, context around hits, satellites, token budgets, confidence, citations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as X
from .tables import small

MOST_QUERIES = 20_000
SATELLITES, LEAST_CONFIDENCE = 4, 0.15
_CJK = "[一-鿿぀-ヿ가-힯]"


def _any(c: Column, phrases: list[str]) -> Column:
    return c.rlike("|".join("\\Q" + p + "\\E" for p in phrases))


def _is_cjk(w: str) -> bool:
    return any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯" for c in w)


_ALONE = "(?U)" + "|".join([r"\b(?:" + "|".join(w for w in L.OVERVIEW_WORDS if not _is_cjk(w)) + r")\b", *[w for w in L.OVERVIEW_WORDS if _is_cjk(w)]])
_COMPARE = r"(?U)\b(?:" + "|".join(L.COMPARE_WORDS) + r")\b"


def route(query: Column) -> Column:
    """global, local or hybrid, by phrases: overviews and comparisons with little else are global."""
    q = X.strip(F.lower(query))
    bare = F.regexp_replace(q, r"^[?.! ]+|[?.! ]+$", "")
    n = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    overview = _any(q, L.OVERVIEW_PHRASES) | q.rlike(_ALONE)
    compared = _any(q, L.COMPARE_PHRASES) | q.rlike(_COMPARE)
    # phrases go one after the other, since one may uncover the next
    rest = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(" ")), [*L.OVERVIEW_PHRASES, *L.COMPARE_PHRASES], q)
    rest = F.regexp_replace(F.regexp_replace(rest, _ALONE, " "), _COMPARE, " ")
    content = F.size(F.filter(F.split(rest, r"(?U)\s+"), lambda w: (F.length(w) > 3) & ~w.isin(L.FILLER)))
    short = (n <= 3) | (q.rlike(_CJK) & (F.length(q) <= 12))
    return (
        F.when(bare.isin(L.OVERVIEW_WORDS + L.OVERVIEW_PHRASES), "global").when(_any(q, L.LOCAL_PHRASES), "local").when(short, F.when(overview, "global").otherwise("hybrid"))
        .when(~(overview | compared), "hybrid").when(content <= 3, "global").otherwise("hybrid")
    )


def route_by_centroids(queries: DataFrame, examples: DataFrame, margin: float = 0.05) -> DataFrame:
    """qid, route: hybrid queries of four words or more may turn global or local by their vector's nearest mean.

    queries: qid, text, vector.  examples: route, vector (a few rows a route).
    """
    each = examples.select("route", F.posexplode("vector").alias("i", "v")).groupBy("route", "i").agg(F.avg("v").alias("v"))
    means = each.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    row = means.groupBy().pivot("route", ["global", "hybrid", "local"]).agg(F.first("mean"))
    sim = lambda k: F.coalesce(F.round(X.cosine(F.col("vector"), F.col(k)), 6), F.lit(-1.0))
    out = queries.crossJoin(F.broadcast(row)).withColumn("by_text", route(F.col("text")))  # one row
    g, h, l = sim("global"), sim("hybrid"), sim("local")
    other = F.when((g > h + margin) & (g >= l), "global").when((l > h + margin) & (l > g), "local").otherwise("hybrid")
    return out.select("qid", F.when((F.col("by_text") == "hybrid") & (X.word_count(F.col("text")) >= 4), other).otherwise(F.col("by_text")).alias("route"))


def parent_windows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, id, context: a hit's text, then those of its parent span (or its two neighbours) in order, each text once.

    Places of a source are consecutive, so the span is a range of places: each chunk is offered to the places it may serve
    and the join is by source and place, not by a range.
    """
    own = hits.select("qid", "id").join(chunks.select("id", "source", "chunk_index", "text", "parent_span"), "id")
    lo = F.coalesce(F.col("parent_span")[0], F.greatest(F.lit(0), F.col("chunk_index") - 1))
    hi = F.coalesce(F.col("parent_span")[1], F.col("chunk_index") + 1)
    wanted = own.select("qid", "id", "source", F.col("chunk_index").alias("self"), F.explode(F.sequence(lo, hi)).alias("chunk_index"))
    met = wanted.join(chunks.select("source", "chunk_index", "text"), ["source", "chunk_index"])
    key = F.struct(F.when(F.col("chunk_index") == F.col("self"), -1).otherwise(F.col("chunk_index")).alias("at"), "text")
    listed = met.groupBy("qid", "id").agg(F.array_sort(F.collect_set(key)).alias("parts"))
    return listed.select("qid", "id", F.array_join(F.array_distinct(F.filter(F.transform("parts", lambda x: x["text"]), lambda t: t != "")), "\n\n").alias("context"))


def basin_mates(hits: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """qid, id, place: other members of the hits' basins, by hit then hops then id, at most ``most`` a query."""
    basin = chunks.select("id", "basin_id", "hops")
    seeds = hits.join(basin.select("id", "basin_id"), "id").groupBy("qid", "basin_id").agg(F.min("rank").alias("seed"))
    mates = seeds.join(basin, "basin_id").join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    w = Window.partitionBy("qid").orderBy("seed", "hops", "id")
    return mates.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("qid", "id", "place")


def confidence(hubs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, confidence: the best cosine of a query with the hubs that are returned for it, 0 at least."""
    met = hubs.select("qid", "id").join(vectors.select("id", "vector"), "id").join(small(queries.select("qid", F.col("vector").alias("q")), MOST_QUERIES), "qid")
    return met.groupBy("qid").agg(F.greatest(F.lit(0.0), F.max(F.round(X.cosine(F.col("vector"), F.col("q")), 6))).alias("confidence"))


def packets(seeds: DataFrame, chunks: DataFrame, k: int, context: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """qid, hubs, neighbors, satellites (arrays), ids: what a briefing shows.

    seeds: qid, id, rank (more than ``k`` of them).  The first ``k`` are hubs with their parent windows.  Context (qid, id,
    place) and basin mates follow; seeds beyond ``k`` count as seen and never come back.  labels: basin_id, label.
    """
    windows = parent_windows(seeds, chunks)
    hubs = seeds.join(windows, ["qid", "id"]).filter(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "context"))).alias("h"))
    mates = basin_mates(seeds, chunks, max(k, 1)).withColumn("stage", F.lit(1))
    around = mates if context is None else mates.unionByName(context.select("qid", "id", "place", F.lit(0).alias("stage")))
    new = around.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti").groupBy("qid", "id").agg(F.min(F.struct("stage", "place")).alias("at"))
    near = new.join(parent_windows(new, chunks), ["qid", "id"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "id", "context"))).alias("n"))
    out = hubs.join(near, "qid", "left")
    if labels is not None:
        told = seeds.join(chunks.select("id", "basin_id"), "id").join(labels, "basin_id").groupBy("qid", X.capped(F.col("label")).alias("label")).agg(F.min("rank").alias("r")).filter("label <> ''")
        out = out.join(told.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("satellites")), "qid", "left")
    else:
        out = out.withColumn("satellites", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    text, ids = (lambda c: F.coalesce(F.transform(c, lambda x: x["context"]), none)), (lambda c: F.coalesce(F.transform(c, lambda x: x["id"].cast("string")), none))
    return out.select("qid", text(F.col("h")).alias("hubs"), text(F.col("n")).alias("neighbors"), F.coalesce("satellites", none).alias("satellites"), F.concat(ids(F.col("h")), ids(F.col("n"))).alias("ids"))


def _render(label: str, body: list[str]) -> str:
    return f"[{label}]\n" + "\n\n".join(body)


def estimate(text: str) -> int:
    """The briefing's token estimate, for code on texts (``functions.text.briefing_tokens`` is the column)."""
    cjk = sum(_is_cjk(c) for c in text)
    return cjk + (sum(not c.isspace() and not _is_cjk(c) for c in text) + 1) // 2


def as_context(hubs: list[str], neighbors: list[str], satellites: list[str], budget: int = 2000, count: Callable[[str], int] = estimate) -> str:
    """Sections of a packet in order; a section ends at its first overflow and the next one is tried."""
    done: list[str] = []
    for label, items in (("Hubs", hubs), ("Neighbors", neighbors), ("Satellites", [s.strip()[:400].rstrip() for s in satellites[:SATELLITES]])):
        body: list[str] = []
        for item in items:
            if count("\n\n".join([*done, _render(label, [*body, item])])) > budget:
                break
            body.append(item)
        if body:
            done.append(_render(label, body))
    return "\n\n".join(done)


def contexts(packet: DataFrame, budget: int = 2000) -> DataFrame:
    """qid, context: ``as_context`` of each packet (the count depends on what was taken, so it runs text by text)."""
    budgeted = F.udf(lambda h, n, s: as_context(h or [], n or [], s or [], budget), "string", useArrow=True)
    return packet.select("qid", budgeted("hubs", "neighbors", "satellites").alias("context"))


def budgeted_prompt(packet: dict, question: str, system: str, window: int = 8192, reserve: int = 1024, count: Callable[[str], int] = estimate) -> str:
    """The user prompt with as much evidence, marked by its reference, as instructions, question and answer leave room for."""
    ids = iter(packet["ids"])
    marked = lambda items: [f"[ref:{i}] {t}" if (i := next(ids, "")) else t for t in items]
    parts = {"Hubs": marked(packet["hubs"]), "Neighbors": marked(packet["neighbors"]), "Satellites": [s.strip()[:400].rstrip() for s in packet["satellites"][:SATELLITES]]}
    taken: dict[str, list[str]] = {k: [] for k in parts}
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def prompt() -> str:
        body = "\n\n".join(_render(k, v) for k, v in taken.items() if v)
        return f'<retrieved_context trust="untrusted">\n{esc(body)}\n</retrieved_context>\n<user_question>\n{esc(question)}\n</user_question>\nResposta:'

    if count(f"{system}\n{prompt()}") > window - reserve:
        raise ValueError("instructions and question alone exceed the model's window")
    for label, items in parts.items():
        for item in filter(None, map(str.strip, items)):
            taken[label].append(item)
            if count(f"{system}\n{prompt()}") > window - reserve:
                taken[label].pop()
                break
    return prompt()


def as_documents(packet: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, role, text: hubs then context, cut to ``k``; ids without a chunk are skipped."""
    rows = packet.select("qid", F.size("hubs").alias("n_hubs"), F.posexplode("ids").alias("p", "id"))
    met = rows.join(chunks.select(F.col("id").cast("string").alias("id"), "text"), "id")
    out = met.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("p"))).filter(F.col("rank") <= k)
    return out.select("qid", "rank", "id", F.when(F.col("p") < F.col("n_hubs"), "seed").otherwise("context").alias("role"), "text")


def abstains(context: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Whether no answer should be tried: no text, or too little support."""
    return (F.coalesce(F.length(X.strip(context)), F.lit(0)) == 0) | (F.coalesce(confidence, F.lit(0.0)) < least)


def citations(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[ref:([^\]]+)\]"), F.lit(1)))


def citations_hold(answer: Column, ids: Column) -> Column:
    """Whether an answer cites only what was retrieved."""
    return F.size(F.array_except(citations(answer), ids)) == 0


def rerank(hits: DataFrame, texts: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """Hits by a pair scorer (query texts, passages -> scores), best first, ties by the old rank.  hits: qid, id, rank, query."""
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype=float)

    scored = hits.join(texts.select("id", "text"), "id").withColumn("rerank_score", F.pandas_udf(score, "double")("query", "text"))
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), F.col("rank"))
    return scored.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k).select("qid", "id", "rerank_score", F.col("new_rank").alias("rank"))


def evidence_rows(chunks: DataFrame, most: int = 10, chars: int = 500) -> DataFrame:
    """basin_id, place, text: the members that a summary is written from, by hops then id."""
    w = Window.partitionBy("basin_id").orderBy("hops", "id")
    return chunks.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("basin_id", "place", F.substring("text", 1, chars).alias("text"))


def basin_labels(chunks: DataFrame, texts: int = 8, words: int = 5) -> DataFrame:
    """basin_id, label: the commonest keywords of a basin's first texts, with the file's name before them."""
    w = Window.partitionBy("basin_id").orderBy("hops", "id")
    first = chunks.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= texts)
    toks = first.select("basin_id", "r", F.posexplode(X.keyword_tokens(X.tokens(F.col("text")))).alias("p", "term"))
    each = toks.groupBy("basin_id", "term").agg(F.count("*").alias("c"), F.min(F.struct("r", "p")).alias("at"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("basin_id").orderBy(F.desc("c"), "at"))).filter(F.col("n") <= words)
    said = top.groupBy("basin_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ").alias("kw"))
    src = chunks.groupBy("basin_id").agg(F.when(F.countDistinct("source") == 1, F.min("source").cast("string")).otherwise("").alias("source"))
    name = F.regexp_extract("source", r"([^/\\]*)$", 1)
    kw = F.coalesce("kw", F.lit(""))
    return src.join(said, "basin_id", "left").select("basin_id", F.when(name != "", F.concat(name, F.lit(": "), kw)).otherwise(kw).alias("label"))
