"""Walks over the chunk graph for a batch of queries: candidates, hops, personalised PageRank, local search, entities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import ENTITY_PARTS, ENTITY_STOP_WORDS
from . import lexical
from .tables import table

#: Of a bucket: entities and rows that a task of the entity search holds together; rows of masses that are made at once.
HELD, ROWS, PART = 3_000_000, 20_000, 50_000
#: Queries whose masses travel together.
MOST_QUERIES = 500


def neighbours(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """src, dst, weight, type in both directions, of one kind or all."""
    rows = edges if kind is None else edges.filter(F.col("type") == kind)
    return rows.select("src", "dst", "weight", "type").unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "type"))


def expand_candidates(seeds: DataFrame, chunks: DataFrame, edges: DataFrame, radius: int = 2, most: int = 100) -> DataFrame:
    """qid, id, place: new nodes around the seeds (qid, id, rank), first along the text, then basin mates, then virtual edges.

    Order: stage, seed's rank, distance, id; each node once, at most ``most`` a query.
    """
    along, virtual = neighbours(edges, "sequential"), neighbours(edges, "virtual-edge")
    front = seeds.select("qid", "id", F.col("rank").alias("seed"))
    walks = None
    for d in range(1, radius + 1):
        front = front.join(along.select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id"), "seed").distinct()
        step = front.withColumn("stage", F.lit(1)).withColumn("far", F.lit(d))
        walks = step if walks is None else walks.unionByName(step)
    basin = chunks.select("id", "basin_id")
    mates = seeds.join(basin, "id").select("qid", F.col("rank").alias("seed"), "basin_id").join(basin, "basin_id").select("qid", "id", "seed", F.lit(2).alias("stage"), F.lit(0).alias("far"))
    near = walks.unionByName(mates)
    start = seeds.select("qid", "id", F.col("rank").alias("seed")).unionByName(near.select("qid", "id", "seed")).groupBy("qid", "id").agg(F.min("seed").alias("seed"))
    links = start.join(virtual.select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id"), "seed", F.lit(3).alias("stage"), F.lit(0).alias("far"))
    every = near.unionByName(links).join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
    first = every.groupBy("qid", "id").agg(F.min(F.struct("stage", "seed", "far")).alias("key"))
    w = Window.partitionBy("qid").orderBy("key", "id")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("qid", "id", "place")


def query_hops(seeds: DataFrame, candidates: DataFrame, edges: DataFrame, deepest: int | None = None) -> DataFrame:
    """qid, id, hop: breadth first from the seeds within each query's candidates, until nothing new is reached (or ``deepest``)."""
    links = neighbours(edges).select(F.col("src").alias("id"), "dst").distinct()
    found = seeds.select("qid", "id").distinct().join(candidates.select("qid", "id").distinct(), ["qid", "id"], "left_semi").withColumn("hop", F.lit(0))
    front = found
    for d in count(1) if deepest is None else range(1, deepest + 1):
        step = front.join(links, "id").select("qid", F.col("dst").alias("id")).distinct().join(candidates, ["qid", "id"], "left_semi").join(found, ["qid", "id"], "left_anti")
        front = table(step.select("qid", "id", F.lit(d).alias("hop")))
        if not front.limit(1).count():
            break
        found = table(found.unionByName(front))
    return found


def local_subgraph(hits: DataFrame, chunks: DataFrame, edges: DataFrame, entries: int = 3, heads: int = 10) -> DataFrame:
    """qid, id: basins of the first hits, the best hits, their virtual neighbours, and what stands next to any of these."""
    basin = chunks.select("id", "basin_id")
    own = hits.filter(F.col("rank") <= entries).join(basin, "id").select("qid", "basin_id").distinct().join(basin, "basin_id").select("qid", "id")
    top = hits.filter(F.col("rank") <= heads).select("qid", "id")
    linked = top.join(neighbours(edges, "virtual-edge").select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id"))
    core = own.union(top).union(linked).distinct()
    beside = core.join(neighbours(edges, "sequential").select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id"))
    return core.union(beside).distinct()


def pagerank(allowed: DataFrame, seeds: DataFrame, edges: DataFrame, alpha: float = 0.50, rounds: int = 15, tolerance: float = 1e-5) -> DataFrame:
    """qid, id, ppr (largest 1): weighted walks that return to the seeds (qid, id, weight); stranded mass returns too.

    All queries move together; a query whose scores have settled keeps them.  A table every third round cuts the plan.
    """
    links = neighbours(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    inside = links.join(allowed.select("qid", F.col("id").alias("src")), "src").join(allowed.select("qid", F.col("id").alias("dst")), ["qid", "dst"])
    total = inside.groupBy("qid", "src").agg(F.sum("weight").alias("total"))
    moves = table(inside.join(total, ["qid", "src"]).select("qid", "src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    mass = seeds.groupBy("qid").agg(F.sum("weight").alias("all"))
    base = allowed.join(seeds.select("qid", "id", "weight"), ["qid", "id"], "left").join(mass, "qid").select("qid", "id", (F.coalesce("weight", F.lit(0.0)) / F.col("all")).alias("home"))
    base = base.join(total.select("qid", F.col("src").alias("id"), F.lit(False).alias("stranded")), ["qid", "id"], "left").withColumn("stranded", F.coalesce("stranded", F.lit(True)))
    state = table(base.withColumn("x", F.col("home")).withColumn("done", F.lit(False)))
    w = Window.partitionBy("qid")
    for k in range(rounds):
        got = moves.join(state.select("qid", F.col("id").alias("src"), "x"), ["qid", "src"]).groupBy("qid", F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("x")).alias("got"))
        lost = F.sum(F.when(F.col("stranded"), F.col("x")).otherwise(0.0)).over(w)
        new = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("home")) + (1 - alpha) * F.col("home")
        nxt = state.withColumn("lost", lost).join(got, ["qid", "id"], "left").withColumn("y", F.when(F.col("done"), F.col("x")).otherwise(new))
        nxt = nxt.withColumn("moved", F.sum(F.abs(F.col("y") - F.col("x"))).over(w))
        state = nxt.select("qid", "id", "home", "stranded", F.col("y").alias("x"), (F.col("done") | (F.col("moved") < tolerance)).alias("done"))
        if k % 3 == 2:
            state = table(state)
            if not state.filter(~F.col("done")).limit(1).count():
                break
    top = F.max("x").over(w)
    return state.select("qid", "id", F.round(F.when(top > 0, F.col("x") / top).otherwise(0.0), 6).alias("ppr"))


def local_search(hits: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 10, least: float = 0.15, budget: int = 2000) -> DataFrame:
    """qid, id, score, rank: similarity, PageRank and hops together, taken until ``k`` or the token budget; hits need ``score``.

    A query whose best hit is under ``least`` gets nothing.  The first row always stays; the first that overflows ends the list.
    """
    strong = hits.withColumn("top", F.max("score").over(Window.partitionBy("qid"))).filter(F.col("top") >= least)
    allowed = local_subgraph(strong, chunks, edges)
    seeds = strong.filter(F.col("rank") <= 3).select("qid", "id", F.col("score").alias("weight"))
    ppr = pagerank(allowed, seeds, edges)
    hop = query_hops(seeds.select("qid", "id"), allowed, edges)
    out = ppr.join(strong.select("qid", "id", "score"), ["qid", "id"], "left").join(hop, ["qid", "id"], "left").join(chunks.select("id", "text"), "id")
    far = F.coalesce("hop", F.max("hop").over(Window.partitionBy("qid")) + 1, F.lit(0))
    value = F.when(F.col("score").isNotNull(), 0.6 * F.col("score") + 0.4 * F.col("ppr")).otherwise(0.5 * F.col("ppr")) * (0.7 + 0.3 * F.exp(-0.35 * far))
    out = out.withColumn("score", F.round(value, 6)).withColumn("far", far)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "far", "id")
    out = out.withColumn("rank", F.row_number().over(w)).withColumn("spent", F.sum(F.floor(F.length("text") / 4)).over(w))
    over = F.max(F.when((F.col("spent") > budget) & (F.col("rank") > 1), 1).otherwise(0)).over(w)
    return out.withColumn("over", over).filter((F.col("over") == 0) & (F.col("rank") <= k)).select("qid", "id", "score", "rank")


def entities(docs: DataFrame) -> DataFrame:
    """id, entity: identifiers of a text and their parts (by letter case, digits and underscores), in lower case, without stop words."""
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$"))
    parts = F.filter(F.regexp_extract_all("e", F.lit(ENTITY_PARTS), F.lit(0)), lambda p: F.length(p) > 2)
    token = docs.select("id", F.explode(words).alias("e")).filter(~F.lower("e").isin(*ENTITY_STOP_WORDS))
    every = token.select("id", F.explode(F.concat(F.array("e"), parts)).alias("e")).select("id", F.lower("e").alias("entity"))
    return every.filter(~F.col("entity").isin(*ENTITY_STOP_WORDS)).distinct()


def entity_search(index: DataFrame, queries: DataFrame, k: int = 10, documents: int | None = None) -> DataFrame:
    """qid, id, score, rank: documents by the idf of shared entities, plus what reaches them through entities of other such documents.

    Every document that shares an entity with the query passes its score on, damped by how common the entity is, to the other
    documents that have it.  An entity's whole mass is summed once and each document's own part taken off again, so no pairs
    of documents are made.  ``documents``: how many there are, with those that have no entity (default: those that have one).
    """
    n = documents or index.select("id").distinct().count()
    df = index.groupBy("entity").agg(F.countDistinct("id").alias("df")).withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    direct = table(queries.join(df, "entity").join(index, "entity").groupBy("qid", "id").agg(F.sum("idf").alias("score")))
    rare = df.filter("idf > 0.5").select("entity", (0.05 * F.col("idf") / (1.0 + F.col("df"))).alias("damped"))
    links = index.join(rare, "entity")
    held = direct.join(links, "id")
    mass = held.groupBy("qid", "entity").agg(F.sum(F.col("score") * F.col("damped")).alias("mass"))
    through = mass.join(index, "entity").groupBy("qid", "id").agg(F.sum("mass").alias("more"))
    own = held.groupBy("qid", "id").agg(F.sum(F.col("score") * F.col("damped")).alias("own"))
    out = direct.join(through, ["qid", "id"], "full_outer").join(own, ["qid", "id"], "left")
    zero = F.lit(0.0)
    # what reaches a document is what all direct ones sent into its entities but for its own part; one that only sent to itself stays as it is
    out = out.select("qid", "id", F.round(F.coalesce("score", zero) + F.coalesce("more", zero) - F.coalesce("own", zero), 6).alias("score")).filter("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_RUNS, _NAME = re.compile(r"\w+").findall, re.compile("[A-Za-z_][A-Za-z0-9_]{2,}").fullmatch
_PARTS, _STOP = re.compile(ENTITY_PARTS).findall, frozenset(ENTITY_STOP_WORDS)


def entity_lists(docs: DataFrame) -> DataFrame:
    """id, entities, bucket: ``entities`` a row a text, taken where the text is; a bucket holds neighbouring texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = TaskContext.get().partitionId() << 24, 0, 0
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            lists, buckets = [], []
            for text in b.column(1):
                found: set[str] = set()
                for w in set(_RUNS(text.as_py() or "")):
                    if (e := known.get(w)) is None:
                        e = tuple(x for x in (w.lower(), *(p.lower() for p in _PARTS(w) if len(p) > 2)) if x not in _STOP) if _NAME(w) and w.lower() not in _STOP else ()
                        if len(known) < 500_000:
                            known[w] = e
                    found.update(e)
                if held and held + len(found) > HELD or rows == ROWS:
                    at, held, rows = at + 1, 0, 0
                held, rows = held + len(found), rows + 1
                lists.append(list(found))
                buckets.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string())), pa.array(buckets, pa.int64())], names=["id", "entities", "bucket"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, entities array<string>, bucket long")


def _sparse(m: np.ndarray) -> tuple[pa.Array, pa.Array]:
    r, c = np.nonzero(m)
    offsets = pa.array(np.searchsorted(r, np.arange(len(m) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(m[r, c]))


def _dense(qs: pa.Array, vs: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(qs), width))
    out[np.repeat(np.arange(len(qs)), pc.list_value_length(qs).to_numpy(zero_copy_only=False)), qs.flatten().to_numpy(zero_copy_only=False)] = vs.flatten().to_numpy(zero_copy_only=False)
    return out


def entity_walk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``entity_search`` over whole texts (id, text) for qid, entity: qid, id, score, rank.

    Scores of all queries stand in a row of numbers, a document's or an entity's, so no row a document, query and entity is
    made.  A bucket of documents sums the masses of its own vocabulary, these meet by entity, and the sums go back to the
    buckets.  An entity of one document gives back what it got and is left out.
    """
    counts = table(entity_lists(docs))
    if counts.groupBy("id").count().filter("count > 1").limit(1).count():
        return entity_search(table(counts.select("id", F.explode("entities").alias("entity")).distinct()), queries, k, docs.count())
    n = counts.count()
    each = counts.select("bucket", F.explode("entities").alias("entity")).groupBy("bucket", "entity").agg(F.count("*").alias("here"))
    vocabulary = table(each.withColumn("df", F.sum("here").over(Window.partitionBy("entity"))).drop("here"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    asked = queries.join(vocabulary.select("entity", "df").distinct(), "entity").select("qid", "entity", idf.alias("idf")).orderBy("qid", "entity").collect()
    damped = vocabulary.filter("df > 1").withColumn("idf", idf).filter("idf > 0.5").select("bucket", "entity", (0.05 * F.col("idf") / (1.0 + F.col("df"))).alias("damped"))
    qids = sorted({r.qid for r in asked})
    qkind = dict(queries.dtypes)["qid"]
    out = None
    for lo in range(0, max(1, len(qids)), MOST_QUERIES):
        some = qids[lo : lo + MOST_QUERIES]
        place = {q: i for i, q in enumerate(some)}
        wanted: dict[str, list[tuple[int, float]]] = {}
        for r in asked:
            if r.qid in place:
                wanted.setdefault(r.entity, []).append((place[r.qid], r.idf))
        hits = _walked(counts, damped, wanted, len(some), k)
        one = hits.join(F.broadcast(lexical.named(docs.sparkSession, some, qkind)), "q").select("qid", "id", "score")
        out = one if out is None else out.unionByName(one)
    return lexical.top_k(out, k)


def _walked(counts: DataFrame, damped: DataFrame, wanted: dict[str, list[tuple[int, float]]], nq: int, k: int) -> DataFrame:
    kind = dict(counts.dtypes)["id"]

    def postings(left: pa.Table, names: pa.Array):
        """The rows' direct scores, and for each posting its row and the place of its entity in names, by that place."""
        lists = left.column("entities").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        direct = np.zeros((len(lists), nq))
        known = {at: wanted[x] for at, x in enumerate(coded.dictionary.to_pylist()) if x in wanted}
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        for at, links in known.items():
            rows = row[order[starts[at] : starts[at + 1]]]  # an entity stands once in a row
            for q, v in links:
                direct[rows, q] += v
        to = pc.fill_null(pc.index_in(coded.dictionary, names), -1).to_numpy(zero_copy_only=False) if len(names) else np.full(len(coded.dictionary), -1)
        name = to[code]
        held = np.flatnonzero(name >= 0)
        held = held[np.argsort(name[held], kind="stable")]
        return direct, row[held], name[held]

    def parts(name: np.ndarray, total: int) -> Iterator[tuple[int, int, int, int]]:
        """Runs of about PART postings: first and last place in name, first and last entity."""
        starts = np.searchsorted(name, np.arange(total + 1))
        e = 0
        while e < total:
            f = max(e + 1, int(np.searchsorted(starts, starts[e] + PART, side="right")) - 1)
            yield starts[e], starts[f], e, f
            e = f

    told = pa.schema([("bucket", pa.int64()), ("entity", pa.string()), ("damped", pa.float64()), ("qs", pa.list_(pa.int16())), ("vs", pa.list_(pa.float64()))])

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows or not nq:
            return told.empty_table()
        names, factor = right.column("entity").combine_chunks(), right.column("damped").to_numpy()
        direct, row, name = postings(left, names)
        out = []
        for a, b, e, f in parts(name, len(names)):
            m = np.add.reduceat(direct[row[a:b]], np.searchsorted(name[a:b], np.arange(e, f)), axis=0) * factor[e:f, None]
            qs, vs = _sparse(m)
            out.append(pa.Table.from_arrays([pa.array(np.full(f - e, key[0].as_py())), names.slice(e, f - e), pa.array(factor[e:f]), qs, vs], schema=told))
        return pa.concat_tables(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums by entity, a row for each bucket that has it; rows come by entity."""

        def summed(t: pa.Table) -> pa.RecordBatch:
            names = t.column("entity").combine_chunks()
            first = np.r_[0, np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1]
            m = np.add.reduceat(_dense(t.column("qs").combine_chunks(), t.column("vs").combine_chunks(), nq), first, axis=0)
            which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(names)]))
            qs, vs = _sparse(m)
            return pa.RecordBatch.from_arrays([t.column("bucket").combine_chunks(), names, t.column("damped").combine_chunks(), qs.take(pa.array(which)), vs.take(pa.array(which))], schema=told)

        rest = None
        for whole in batches:
            for lo in range(0, whole.num_rows, PART // 10):
                t = pa.Table.from_batches([whole.slice(lo, PART // 10)]).cast(told)
                t = t if rest is None else pa.concat_tables([rest, t])
                names = t.column("entity").combine_chunks()
                last = int(pc.index(pc.equal(names, names[-1]), True).as_py())  # the last entity may go on
                if last:
                    yield summed(t.slice(0, last))
                rest = t.slice(last)
        if rest is not None:
            yield summed(rest)

    def receive(key, left: pa.Table, right: pa.Table) -> pa.Table:
        best = lexical.Best(nq, k)
        if left.num_rows and nq:
            names, factor = right.column("entity").combine_chunks(), right.column("damped").to_numpy()
            direct, row, name = postings(left, names)
            total = direct * (1.0 - np.bincount(row, factor[name], left.num_rows)[:, None])
            qs, vs = right.column("qs").combine_chunks(), right.column("vs").combine_chunks()
            for a, b, e, f in parts(name, len(names)):
                m = _dense(qs.slice(e, f - e), vs.slice(e, f - e), nq)
                by_row = np.argsort(row[a:b], kind="stable")
                rows, first = np.unique(row[a:b][by_row], return_index=True)
                if len(rows):
                    total[rows] += np.add.reduceat(m[name[a:b][by_row] - e], first, axis=0)
            total = np.round(total, 6)
            total[total <= 0] = -np.inf
            best.add(left.column("id").combine_chunks(), lambda i, j: total[:, i:j])
        out = list(best.batches())
        return pa.Table.from_batches(out) if out else pa.table({"q": pa.array([], pa.int32()), "id": pa.array([], left.schema.field("id").type), "score": pa.array([], pa.float64())})

    ddl = "bucket long, entity string, damped double, qs array<short>, vs array<double>"
    sent = counts.groupBy("bucket").cogroup(damped.groupBy("bucket")).applyInArrow(send, ddl)
    masses = sent.repartition("entity").sortWithinPartitions("entity").mapInArrow(meet, ddl)
    return counts.groupBy("bucket").cogroup(masses.groupBy("bucket")).applyInArrow(receive, f"q int, id {kind}, score double")
