"""The lexical arm: an index of term statistics, BM25 for whole batches of queries, feedback expansion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .tables import small, table

K1, B = 1.2, 0.75
DIGITS = 6
#: Query batches with more terms than this are joined by a shuffle instead of a broadcast.
MOST_QUERY_TERMS = 500_000


#: Postings that are sent on at once, and postings of a bucket (what a task of the vector arm holds together).
PIECE, BUCKET = 1_000_000, 3_000_000


class LexicalIndex:
    """counts (id, dl, terms, tfs, bucket: a row a document), the corpus' size, mean length and main language.

    postings (id, term, tf, dl), vocabulary (bucket, term, df of the bucket) and terms (term, df, idf) follow from them and
    are made when they are asked for.  A bucket holds neighbouring documents, so its vocabulary is much smaller than its
    postings.  ``unique``: no id stands twice.
    """

    def __init__(self, counts: DataFrame, n: int, avgdl: float, lang: str, stem: Callable[[list[str]], list[str]] | None = None, unique: bool = True):
        self.counts, self.n, self.avgdl, self.lang, self.stem, self.unique = counts, n, avgdl, lang, stem, unique

    @property
    def postings(self) -> DataFrame:
        return self.counts.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return table(self.counts.select("bucket", F.explode("terms").alias("term")).groupBy("bucket", "term").agg(F.count("*").alias("df")))

    @cached_property
    def terms(self) -> DataFrame:
        return table(self.weighed(self.vocabulary.groupBy("term").agg(F.sum("df").alias("df"))))

    def weighed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("idf", F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))

    def terms_of(self, wanted: DataFrame) -> DataFrame:
        """term, df, idf of the wanted terms alone."""
        if "terms" in self.__dict__:
            return self.terms.join(wanted, "term", "left_semi")
        if "vocabulary" in self.__dict__:
            return self.weighed(self.vocabulary.join(small(wanted, MOST_QUERY_TERMS), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
        each = self.counts.select(F.explode("terms").alias("term")).join(small(wanted, MOST_QUERY_TERMS), "term", "left_semi")
        return self.weighed(each.groupBy("term").agg(F.count("*").alias("df")))


def term_lists(docs: DataFrame, id_: str = "id", text: str = "text", stem: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """id, lang, terms: tokens without the function words of each text's own language; ``stem`` turns a text's terms into others."""
    toks = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), X.tokens(F.col(text)).alias("toks"))
    known = toks.select("id", "toks", X.language(F.col("text"), F.col("toks")).alias("lang"))
    out = known.select("id", "lang", X.without_stopwords(F.col("toks"), F.col("lang")).alias("terms"))
    return _stemmed(out, stem)


def _stemmed(lists: DataFrame, stem: Callable[[list[str]], list[str]] | None) -> DataFrame:
    if stem is None:
        return lists

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(terms=[stem(list(t)) for t in b["terms"]])

    return lists.mapInPandas(run, lists.schema)


def _counted(docs: DataFrame, stem: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """id, lang, dl, terms, tfs, bucket: each text's distinct terms with their numbers, counted where the text is (no shuffle).

    docs: id, text.  ``X.terms`` gives what ``term_lists`` gives, at a fraction of the time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 24, 0
        names = ["id", "lang", "dl", "terms", "tfs", "bucket"]
        for b in batches:
            ids, begin = b.column(0), 0
            langs, lengths, ends, terms, tfs, buckets = [], [], [0], [], [], []

            def made(end: int):
                offsets = pa.array(ends, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(langs, pa.string()), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())), pa.array(buckets, pa.int64())], names=names
                )  # noqa: B023

            for i, text in enumerate(b.column(1)):
                lang, found = X.terms(text.as_py())
                found = found if stem is None else list(stem(found))
                count = Counter(found)
                if held and held + len(count) > BUCKET:
                    at, held = at + 1, 0
                held += len(count)
                langs.append(lang)
                lengths.append(max(1, len(found)))
                terms += count.keys()
                tfs += count.values()
                ends.append(len(terms))
                buckets.append(at)
                if len(terms) > PIECE:
                    yield made(i + 1)
                    begin, langs, lengths, ends, terms, tfs, buckets = i + 1, [], [], [0], [], [], []
            if langs:
                yield made(b.num_rows)

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, lang string, dl int, terms array<string>, tfs array<int>, bucket long")


def build_index(docs: DataFrame, id_: str = "id", text: str = "text", stem: Callable[[list[str]], list[str]] | None = None) -> LexicalIndex:
    counts = table(_counted(docs.select(F.col(id_).alias("id"), F.col(text).alias("text")), stem))
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    # the most common language; the first in the alphabet wins a tie
    langs = counts.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1).collect()
    twice = counts.groupBy("id").count().filter("count > 1").select("id")
    unique = not twice.limit(1).count()
    if not unique:
        # rows of one id and length count together
        again = counts.join(twice, counts["id"].eqNullSafe(twice["id"]), "left_semi")
        each = again.select("id", "dl", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p")).groupBy("id", "dl", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").cast("int").alias("tf"))
        merged = each.groupBy("id", "dl").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("p")).select("id", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"), F.lit(-1).cast("long").alias("bucket"))
        counts = table(counts.join(twice, counts["id"].eqNullSafe(twice["id"]), "left_anti").select(*merged.columns).unionByName(merged))
    return LexicalIndex(counts.select("id", "dl", "terms", "tfs", "bucket"), stats["n"], stats["avgdl"] or 0.0, langs[0]["lang"] if langs else "pt", stem, unique)


def query_terms(queries: DataFrame, stem: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """qid, term, times: a repeated query term counts as often as it stands there."""
    return term_lists(queries, "qid", stem=stem).select(F.col("id").alias("qid"), F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def bm25(index: LexicalIndex, queries: DataFrame, k: int = 50) -> DataFrame:
    """qid, id, score, rank (from 1) of the best k, ties by id.  Only postings of query terms are scored."""
    asked = table(query_terms(queries, index.stem))
    wanted = table(asked.join(index.terms_of(asked.select("term").distinct()), "term").select("qid", "term", "times", "idf"))
    if index.unique and wanted.limit(MOST_QUERY_TERMS + 1).count() <= MOST_QUERY_TERMS:
        return table(top_k(_scored_in_place(index, wanted, k), k))
    hits = index.postings.join(small(wanted, MOST_QUERY_TERMS), "term")
    norm = F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / (index.avgdl or 1.0))
    part = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1.0) / norm)
    scored = hits.groupBy("qid", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return table(top_k(scored, k))


def _scored_in_place(index: LexicalIndex, wanted: DataFrame, k: int) -> DataFrame:
    """qid, id, score: a document's postings stand in one row, so it is scored there; a task returns its best k a query."""
    rows = wanted.orderBy("term", "qid").collect()  # at most MOST_QUERY_TERMS
    qids = sorted({r.qid for r in rows})
    place = {q: i for i, q in enumerate(qids)}
    vocabulary = list(dict.fromkeys(r.term for r in rows))
    number = {t: i for i, t in enumerate(vocabulary)}
    code = np.array([number[r.term] for r in rows], np.int64)
    starts = np.searchsorted(code, np.arange(len(vocabulary) + 1))
    query, weight = np.array([place[r.qid] for r in rows], np.int64), np.array([r.times * r.idf for r in rows], float)
    avgdl, nq = index.avgdl or 1.0, len(qids)
    schema = wanted.schema

    def score(b: pa.RecordBatch) -> np.ndarray:
        """Documents x queries; those without a term in common are -inf."""
        lens = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        coded = b.column(2).flatten().dictionary_encode()
        to = pc.fill_null(pc.index_in(coded.dictionary, pa.array(vocabulary, pa.string())), -1).to_numpy(zero_copy_only=False)
        term = to[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        known = np.flatnonzero(term >= 0)
        term, row = term[known], np.repeat(np.arange(b.num_rows), lens)[known]
        tf, dl = b.column(3).flatten().to_numpy(zero_copy_only=False)[known].astype(float), b.column(1).to_numpy(zero_copy_only=False)[row]
        part = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avgdl))
        times = starts[term + 1] - starts[term]
        each = np.repeat(np.arange(len(term)), times)
        link = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + starts[term][each]
        cell = row[each] * nq + query[link]
        sums = np.bincount(cell, weight[link] * part[each], b.num_rows * nq)
        sums = np.round(sums.astype(float), DIGITS)  # no weights at all make whole numbers
        met = np.zeros(len(sums), bool)
        met[cell] = True
        sums[~met] = -np.inf
        return sums.reshape(b.num_rows, nq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(nq, k)
        for b in batches:
            step = max(1, CELLS // max(1, nq))
            for lo in range(0, b.num_rows if nq else 0, step):
                part = b.slice(lo, step)
                best.add(part.column(0), lambda i, j, s=score(part): s[:, i:j])
        yield from best.batches()

    kind = dict(index.counts.dtypes)["id"]
    hits = index.counts.select("id", "dl", "terms", "tfs").mapInArrow(run, f"q int, id {kind}, score double")
    return hits.join(F.broadcast(named(wanted.sparkSession, qids, schema["qid"].dataType.simpleString())), "q").select("qid", "id", "score")


def named(spark, qids: list, kind: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(qids)), f"q int, qid {kind}")


#: Scores that stand in memory at once.
CELLS = 2_000_000


class Best:
    """The best k ids of each query, by score then id, over blocks of rows as they come.

    Memory is 2k a query and one tile of scores, whatever the number of rows and of equal scores: a block gives no query more than k.
    Rows may come with a number (``tie``) that decides between equal scores before their ids do.  With ``digits``, scores come as they
    are and only those that may enter are rounded.
    """

    def __init__(self, queries: int, k: int, digits: int | None = None):
        self.queries, self.k, self.digits = queries, k, digits
        self.kept: tuple | None = None  # ids, ties, query, place of its id, score
        self.least = np.full(queries, -np.inf)  # a score under it can't enter
        self.new: list[tuple] = []
        self.held = 0

    def _rounded(self, s: np.ndarray) -> np.ndarray:
        return s if self.digits is None else np.round(s, self.digits)

    def add(self, ids: pa.Array, score: Callable[[int, int], np.ndarray], tie: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """score(i, j): scores of the rows (down) for the queries from i to j (of ``which``, if given); -inf is no hit."""
        which = np.arange(self.queries) if which is None else which
        tie = np.zeros(len(ids), np.int64) if tie is None else tie
        step = max(1, CELLS // max(1, len(ids)))
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        order = None
        for i in range(0, len(which), step):
            some = which[i : i + step]
            s = np.ascontiguousarray(score(i, i + len(some)).T)
            over = s >= np.maximum(self.least[some] - slack, np.finfo(float).min)[:, None]
            many = np.flatnonzero(np.count_nonzero(over, axis=1) > self.k)
            if len(many) and order is None:
                order = pc.sort_indices(ids).to_numpy()
                order = order[np.argsort(tie[order], kind="stable")]
            part = max(1, CELLS // 8 // max(1, len(ids)))
            for lo in range(0, len(many), part):
                rows = many[lo : lo + part]
                over[rows] = self._first(s[rows], over[rows], order)
            q, r = np.nonzero(over)
            if len(q):
                used, at = np.unique(r, return_inverse=True)
                self.new.append((ids.take(pa.array(used)), tie[used], some[q].astype(np.int32), at.astype(np.int32), self._rounded(s[q, r])))
                self.held += len(q)
            if self.held >= max(CELLS // 64, self.queries * self.k):
                self._settle()

    def _first(self, s: np.ndarray, over: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Of what is over the bound (more than k each) the first k, equal scores by ``order``."""
        s = np.where(over, self._rounded(s), -np.inf)[:, order]
        kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
        first, equal = s > kth, s == kth
        first |= equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= self.k - np.count_nonzero(first, axis=1)[:, None])
        out = np.empty_like(first)
        out[:, order] = first
        return out

    def _settle(self) -> None:
        parts = ([] if self.kept is None else [self.kept]) + self.new
        self.new, self.held = [], 0
        if not parts:
            return
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        ids, tie = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        q, s = np.concatenate([p[2] for p in parts]), np.concatenate([p[4] for p in parts])
        at = np.concatenate([p[3] + np.int32(d) for p, d in zip(parts, shift, strict=False)])
        order = np.empty(len(ids), np.int32)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids), dtype=np.int32)
        first = np.lexsort((order[at], tie[at], -s, q))
        q, at, s = q[first], at[first], s[first]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        q, at, s = q[keep], at[keep], s[keep]
        count = np.bincount(q, minlength=self.queries)
        full = np.flatnonzero(count >= self.k)
        self.least[full] = s[np.cumsum(count)[full] - 1]
        used, at = np.unique(at, return_inverse=True)
        self.kept = (ids.take(pa.array(used)), tie[used], q, at.astype(np.int32), s)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """q, id, score: what is held at the end."""
        self._settle()
        if self.kept is None:
            return
        ids, _, q, at, s = self.kept
        for lo in range(0, len(q), CELLS // 8):
            cut = slice(lo, lo + CELLS // 8)
            yield pa.RecordBatch.from_arrays([pa.array(q[cut]), ids.take(pa.array(at[cut])), pa.array(s[cut])], names=["q", "id", "score"])


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def expansion_terms(index: LexicalIndex, queries: DataFrame, hits: DataFrame, docs: DataFrame, n_feedback: int = 3, n_terms: int = 8) -> DataFrame:
    """qid, term, place: terms of the best hits' texts that the query lacks, by tf x idf then term, both descending."""
    lang = queries.select("qid", F.coalesce(X.language(F.col("text"), X.tokens(F.col("text"))), F.lit(index.lang)).alias("lang"))
    texts = hits.filter(F.col("rank") <= n_feedback).select("qid", "id").join(docs.select("id", "text"), "id").join(lang, "qid")
    own = lambda df: _stemmed(df.select("qid", X.without_stopwords(X.tokens(F.col("text")), F.col("lang")).alias("terms")), index.stem).select("qid", F.explode("terms").alias("term"))
    toks = own(texts).filter(F.length("term") >= 3)
    mine = own(queries.join(lang, "qid")).distinct()
    rated = table(toks.groupBy("qid", "term").agg(F.count("*").alias("tf")).join(mine, ["qid", "term"], "left_anti"))
    rated = rated.join(index.terms_of(rated.select("term").distinct()), "term")
    rated = rated.withColumn("w", F.round(F.col("tf") * F.col("idf"), DIGITS))
    w = Window.partitionBy("qid").orderBy(F.desc("w"), F.desc("term"))
    return rated.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n_terms).select("qid", "term", "place")


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """The queries with their expansion terms behind them."""
    more = terms.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("more"))
    return queries.join(more, "qid", "left").select("qid", F.concat_ws(" ", "text", "more").alias("text"))


def union_passes(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Two passes fused by reciprocal ranks; the score is the first pass's where it has one."""
    both = first.select("qid", "id", "score", "rank", F.lit(0).alias("p")).unionByName(second.select("qid", "id", "score", "rank", F.lit(1).alias("p")))
    fused = both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("fused"), F.min_by("score", "p").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).select("qid", "id", "score", "rank")
