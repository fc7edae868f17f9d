"""A batch of query texts against whole documents: which hold a text as it stands, which share enough words with it.

The queries travel with the task and each document is read once, whatever the number of queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Query batches beyond this are joined instead.
MOST_QUERIES = 20_000
#: Bytes of text that are looked through at once.
BYTES = 2_000_000
_WORDS = re.compile("[a-z0-9]{3,}").findall


def _keys(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on, as one number."""
    out, have = data.astype(np.uint64), 1
    while have < width:
        step = min(have, width - have)
        out = out[:-step] | out[step:] << np.uint64(8 * step)  # what overlaps is the same bytes
        have += step
    return out


def holders(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id: the documents (id, text) that hold a query's text (qid, text)."""
    rows = queries.select("qid", "text").filter("text is not null").distinct()
    if rows.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        return docs.select("id", "text").join(rows.withColumnRenamed("text", "qtext"), F.contains(F.col("text"), F.col("qtext"))).select("qid", "id").distinct()
    asked = [(r.qid, r.text.encode()) for r in rows.collect()]
    texts = [t for _, t in asked]
    widths = {w: [i for i, t in enumerate(texts) if min(8, len(t)) == w] for w in {min(8, len(t)) for t in texts}}
    key = lambda t, w: int(_keys(np.frombuffer(t, np.uint8)[:w], w)[0])
    heads = {w: {} for w in widths if w}
    for w, held in heads.items():
        for i in widths[w]:
            held.setdefault(key(texts[i], w), []).append((i, len(texts[i]) - w, key(texts[i][-w:], w)))
    kind, qkind = dict(docs.dtypes)["id"], dict(queries.dtypes)["qid"]

    def found(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, query), some more than once."""
        for w, held in heads.items():
            if len(data) < w:
                continue
            keys = _keys(data, w)
            first = np.array(sorted(held), np.uint64)
            mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
            some = np.zeros(1 << 18, bool)
            some[mix(first)] = True
            at = np.flatnonzero(some[mix(keys)])
            at = at[np.isin(keys[at], first)]
            order = np.argsort(keys[at], kind="stable")
            at = at[order]
            ends = np.searchsorted(keys[at], np.r_[first], side="right")
            begins = np.searchsorted(keys[at], first)
            for k, lo, hi in zip(first.tolist(), begins, ends, strict=True):
                for i, shift, last in held[k] if hi > lo else ():
                    here = at[lo:hi]
                    here = here[here + shift < len(keys)]
                    here = here[keys[here + shift] == np.uint64(last)]
                    row = np.searchsorted(offsets, here, side="right") - 1
                    whole = here + len(texts[i]) <= offsets[row + 1]
                    for p, r in zip(here[whole].tolist(), row[whole].tolist(), strict=True):
                        if data[p : p + len(texts[i])].tobytes() == texts[i]:
                            yield r, i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + b.num_rows + 1]
            cuts = np.unique(np.r_[0, np.searchsorted(sizes - sizes[0], np.arange(BYTES, sizes[-1] - sizes[0], BYTES)), b.num_rows])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = column.slice(lo, hi - lo)
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[sizes[lo] : sizes[hi]]
                met = set(found(data, sizes[lo : hi + 1] - sizes[lo]))
                if 0 in widths:
                    met |= {(int(r), i) for r in np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)) for i in widths[0]}
                if met:
                    r, q = np.array(sorted(met)).T
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b.column(0).slice(lo, hi - lo).take(pa.array(r))], names=["q", "id"])

    hits = docs.select("id", "text").mapInArrow(run, f"q int, id {kind}")
    names = docs.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], f"q int, qid {qkind}")
    return hits.join(F.broadcast(names), "q").select("qid", "id").distinct()


def evidence(docs: DataFrame, queries: DataFrame, jaccard: float = 0.15, contained: float = 0.5) -> DataFrame:
    """id, qid: ``X.evidence_hit`` of each document's and each query's ``X.evidence_tokens``, by the queries' tokens alone."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        a = docs.select("id", X.evidence_tokens(F.col("text")).alias("a"))
        b = queries.select("qid", X.evidence_tokens(F.col("text")).alias("b"))
        return a.join(b, X.evidence_hit(F.col("a"), F.col("b"), jaccard, contained)).select("id", "qid")
    asked = [(r.qid, r.b) for r in queries.select("qid", X.evidence_tokens(F.col("text")).alias("b")).collect() if r.b]
    sizes = np.array([len(b) for _, b in asked], np.int64)
    has: dict[str, list[int]] = {}
    for i, (_, b) in enumerate(asked):
        for t in b:
            has.setdefault(t, []).append(i)
    has = {t: np.array(v) for t, v in has.items()}
    kind, qkind = dict(docs.dtypes)["id"], dict(queries.dtypes)["qid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(b.column(1)):
                words = set(_WORDS((text.as_py() or "").lower()))
                lists = [has[t] for t in words if t in has]
                if lists:
                    met = np.bincount(np.concatenate(lists), minlength=len(sizes))
                    hit = np.flatnonzero((met >= jaccard * (len(words) + sizes - met)) | (met >= contained * sizes))
                    rows.append(np.full(len(hit), i))
                    hits.append(hit)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hits).astype(np.int32)), b.column(0).take(pa.array(np.concatenate(rows)))], names=["q", "id"])

    found = docs.select("id", "text").mapInArrow(run, f"q int, id {kind}")
    names = docs.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], f"q int, qid {qkind}")
    return found.join(F.broadcast(names), "q").select("id", "qid")
