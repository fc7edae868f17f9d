"""Texts into chunks: character, sentence and token splitters, the policy that chooses, and the rows of the index.

The splitters carry state from piece to piece, so they run in Python over Arrow batches, one text at a time; everything
around them (ids, spans, layers, the policy) is DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# Sizes, overlaps and separators of the policies.
SHORT, SHORT_OVERLAP = 512, 128
LEAF, LEAF_OVERLAP, LEAF_SENTENCES = 256, 32, 2
LONG_FROM = 4000
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", " ", "")
SPAN = 3
CODE, CODE_OVERLAP = 1200, 150
CODE_SEPARATORS = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")

BATCH_ROWS = 128
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of a text; each but the first keeps the separator at its head."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in (head, *(sep + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces together up to ``size``; the next chunk begins with up to ``overlap`` of the last one's end."""
    lo = hi = width = 0
    for k, p in enumerate(pieces):
        if width + len(p) > size:
            if hi > lo:
                yield "".join(pieces[lo:hi])
            while lo < hi and (width > overlap or width + len(p) > size):
                width -= len(pieces[lo])
                lo += 1
        hi, width = k + 1, width + len(p)
    if hi > lo:
        yield "".join(pieces[lo:hi])


def split_chars(text: str, size: int = SHORT, overlap: int = SHORT_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that does."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, out, fitting = separators[at + 1 :], [], []

    def flush():
        out.extend(c for c in map(str.strip, _packed(fitting, size, overlap)) if c)
        fitting.clear()

    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        flush()
        if finer:
            out += split_chars(piece, size, overlap, finer)
        else:
            out.append(piece)
    flush()
    return out


def split_sentences(text: str, size: int = LEAF, overlap: int = LEAF_OVERLAP, most: int = LEAF_SENTENCES) -> list[str]:
    """Leaves of one or two sentences and at most ``size`` characters.

    A leaf begins with the last sentence of the one before it, and with more of them as far as they fit ``overlap``,
    unless the next sentence wouldn't fit then.
    """
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1) if size > 1 else max(0, overlap)
    text = (text or "").strip()
    units: list[str] = []
    for part in filter(None, map(str.strip, _SENTENCE.split(text))):
        units += [part] if len(part) <= size else [c for c in map(str.strip, split_chars(part, size, overlap)) if c]
    wide = lambda w: sum(map(len, w)) + max(0, len(w) - 1)
    leaves: list[str] = []

    def close(window: list[str]) -> list[str]:
        leaf = " ".join(window)
        if leaves[-1:] != [leaf]:
            leaves.append(leaf)
        if not overlap:
            return []
        first = len(window) - 1
        while first > 0 and wide(window[first - 1 :]) <= overlap:
            first -= 1
        return window[first:]

    window: list[str] = []
    for u in units:
        fits = lambda: wide([*window, u]) <= size  # noqa: B023, E731
        if window and (len(window) >= max(1, most) or not fits()):
            window = close(window)
            if not fits():
                window = []
        window.append(u)
    if window:
        close(window)
    return leaves


def utf8_length(text: str) -> int:
    """Tokens of a text where no tokenizer is at hand: no tokenizer makes more than a token a byte."""
    return len(text.encode())


def split_tokens(text: str, size: int, overlap: int, count: Callable[[str], int] = utf8_length, offsets: Callable[[str], list[tuple[int, int]]] | None = None, limit: int | None = None) -> list[str]:
    """Windows of ``size`` tokens with ``overlap`` in common; ``limit`` (what an encoder reads) bounds them.

    With ``offsets`` (a token's characters) windows are cut by tokens, else the longest prefix that counts few enough is
    searched by halving.
    """
    size = max(1, min(size, limit) if limit else size)
    overlap = min(max(0, overlap), size - 1)
    out: list[str] = []
    if offsets is not None:
        places, i = offsets(text), 0
        while i < len(places):
            last = min(len(places), i + size)
            out.append(text[places[i][0] : places[last - 1][1]])
            i = last - overlap if last < len(places) else last
        return [c for c in out if c.strip()]
    start = 0
    while start < len(text):
        lo, hi = start + 1, len(text)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(text[start:mid]) <= size else (lo, mid - 1)
        out.append(text[start:lo])
        if lo == len(text):
            break
        a, b = start + 1, lo
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if count(text[mid:lo]) <= overlap else (mid + 1, b)
        start = a
    return [c for c in out if c.strip()]


def policy_of(text: Column, forced: str | None = None, threshold: int = LONG_FROM) -> Column:
    if forced:
        return F.lit(forced)
    return F.when(F.length(F.coalesce(text, F.lit(""))) > threshold, "sentence_window").otherwise("legacy_char")


def chunks(docs: DataFrame, forced: str | None = None, size: int = SHORT, overlap: int = SHORT_OVERLAP, leaf: int = LEAF, leaf_overlap: int = LEAF_OVERLAP, split: Callable[[str], list[str]] | None = None) -> DataFrame:
    """doc_id, source, text -> doc_id, source, chunk_index, n_chunks, policy, text.  Blank texts have no chunks.

    ``split`` stands in for the character splitter of short texts.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = dict(docs.dtypes)
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), policy_of(F.col("text"), forced).alias("policy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "chunk_index", "n_chunks", "policy", "text"]
        for b in batches:
            at, index, total, texts = [], [], [], []
            for i, (t, p) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                made = split_sentences(t, leaf, leaf_overlap) if p == "sentence_window" else (split or (lambda x: split_chars(x, size, overlap)))(t)
                made = [c for c in made if c.strip()]
                at += [i] * len(made)
                index += range(len(made))
                total += [len(made)] * len(made)
                texts += made
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(index, pa.int32()), pa.array(total, pa.int32()), b.column(3).take(take), pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, source {kind['source']}, chunk_index int, n_chunks int, policy string, text string")


def nodes(pieces: DataFrame) -> DataFrame:
    """Chunks with id and, for sentence windows, parent_span (the chunks around it that are shown with it)."""
    i, n = F.col("chunk_index"), F.col("n_chunks")
    span = F.when(F.col("policy") == "sentence_window", F.array(F.greatest(F.lit(0), i - SPAN), F.least(n - 1, i + SPAN)))
    return pieces.withColumn("id", X.node_id(F.col("source").cast("string"), i, F.col("text"))).withColumn("parent_span", span)


def flat_nodes(docs: DataFrame) -> DataFrame:
    """One node a document: the index of short documents."""
    named = F.col("doc_id").cast("string")
    return docs.select(named.alias("id"), "doc_id", named.alias("source"), F.lit(0).alias("chunk_index"), F.lit(1).alias("n_chunks"), "text", named.alias("basin_id"), F.lit(0).alias("hops"))


def code_chunks(files: DataFrame) -> DataFrame:
    """Source files (doc_id, source, text) cut before classes and functions where that fits."""
    return chunks(files, forced="legacy_char", split=lambda t: split_chars(t, CODE, CODE_OVERLAP, CODE_SEPARATORS))


def budget_pack(ranked: DataFrame, budget: int, tokens: Column | None = None, by: str = "qid") -> DataFrame:
    """Ranked texts until their tokens overflow the budget; the first stays always, texts that are missing don't count.

    ranked: ``by``, rank, text.
    """
    n = tokens if tokens is not None else X.word_count(F.col("text"))
    rows = ranked.filter(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("tokens", n)
    w = Window.partitionBy(by).orderBy("rank")
    rows = rows.withColumn("spent", F.sum("tokens").over(w)).withColumn("place", F.row_number().over(w))
    over = F.max(F.when((F.col("spent") > budget) & (F.col("place") > 1), 1).otherwise(0)).over(w)
    return rows.withColumn("over", over).filter("over = 0").drop("over", "place")


def mid_excerpts(text: Column, n: int = 3, span: int = 400) -> Column:
    """Passages from the middle third of a text; a short text is its only one, an empty one has none."""
    t = X.strip(F.coalesce(text, F.lit("")))
    size = F.length(t)
    start = F.floor(size / 3).cast("int")
    window = F.substring(t, start + 1, F.least(size - start, F.lit(max(span * n * 2, span))))
    step = F.greatest(F.lit(span), F.floor(F.length(window) / max(1, n)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: X.strip(F.substring(window, i * step + 1, F.lit(span))))
    one = F.when(size > 0, F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.when(size < 2 * span, one).otherwise(F.filter(cut, lambda c: F.length(c) > 80))
