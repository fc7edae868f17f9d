"""5. Quality rules: base counts, and line labelling by a linear-chain conditional random field.

Each line with a word is content or boilerplate.  The field has weights for the line's features and for pairs of
neighbouring labels; Viterbi decoding finds the best labelling of a whole text, and the share of content (by characters)
decides whether the text is kept.

The weights are fitted on the driver to at most ``SAMPLE`` labelled documents (``labels.quality``; the lines of a good document
are content, those of a bad one boilerplate; all their lines, in sequences of ``SEGMENT``) and to generated lines, which
also serve alone where there are no labels.  Everything else covers whole texts.

Defined results: a null text has no words and counts of zero, and fails the base rule (fewer than 10 words), as an empty
one does; a very long text is counted and decoded whole; a text without lines that hold a word has no content share and isn't kept; repeated rows each get their own result;
an empty table gives no rows; other columns pass through, those named like an output column are replaced.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE, SEGMENT = 4000, 32
#: Least share of content, by characters.
SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
CUES = (b"cookie", b"copyright", b"all rights", b"log in", b"sign up", b"subscribe", b"click here", b"privacy", b"terms of", b"share this", b"read more", b"menu")
FEATURES = ("one", "short", "medium", "symbols", "many_symbols", "capitals", "exclaims", "bars", "repeats", "same_word", "sentence", "cue", "long_words", "seen")


def line_features(line: bytes, seen: bool) -> list[float]:
    words = line.split()
    n, size = len(words), max(1, len(line))
    signs = size - len(line.translate(None, SYMBOLS))
    caps = size - len(line.translate(None, UPPER))
    low = line.lower()
    distinct = len(set(words)) / max(1, n)
    return [
        1.0, float(n < 3), float(3 <= n < 8), min(1.0, 10 * signs / size), float(signs > 0.06 * size), float(caps > 0.5 * size),
        min(1.0, line.count(b"!!") * 4 / max(1, n)), min(1.0, line.count(b" | ") * 4 / max(1, n)), float(n >= 8 and distinct < 0.5), float(n >= 4 and words[n // 2] == words[n // 2 - 1]),
        float(words[-1][-1:] in b".!?:\"" if n else 0), float(any(c in low for c in CUES)), float(size / max(1, n) > 14), float(seen),
    ]


def lines_of(data: bytes) -> list[bytes]:
    return [x for x in data.split(b"\n") if x.strip()]


def text_features(lines: list[bytes]) -> list[list[float]]:
    seen: set[bytes] = set()
    out = []
    for x in lines:
        out.append(line_features(x, x in seen))
        seen.add(x)
    return out


class Field:
    """weights: features x 2 labels (1 is content); pairs: previous x next label."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def viterbi(self, x: np.ndarray) -> list[int]:
        if not len(x):
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        scores = (x @ self.weights).tolist()
        a, b = scores[0]
        back = []
        for ea, eb in scores[1:]:
            fa, fb = a + aa >= b + ba, a + ab > b + bb
            a, b = (a + aa if fa else b + ba) + ea, (a + ab if fb else b + bb) + eb
            back.append((0 if fa else 1, 0 if fb else 1))
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; all sequences at once, padded, with forward and backward passes."""
    width, longest = len(FEATURES), max(len(y) for _, y in sequences)
    n = len(sequences)
    x, y, on = np.zeros((n, longest, width)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(sequences):
        x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
    both = on[:, 1:]
    theta = np.zeros(width * 2 + 4)
    hot = np.eye(2)[y] * on[..., None]
    want = np.concatenate([np.einsum("ntf,ntk->fk", x, hot).ravel(), np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]).ravel()])
    m, v, total = np.zeros_like(theta), np.zeros_like(theta), on.sum()
    lse = lambda z, axis: (t := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - t).sum(axis=axis))
    for step in range(1, rounds + 1):
        w, pairs = theta[: width * 2].reshape(width, 2), theta[width * 2 :].reshape(2, 2)
        e = x @ w
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            nxt = lse(fwd[:, t - 1, :, None] + pairs, 1) + e[:, t]
            fwd[:, t] = np.where(on[:, t, None], nxt, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = lse(pairs + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(on[:, t + 1, None], nxt, 0)
        z = lse(fwd[:, -1], 1)
        single = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
        joint = np.exp(fwd[:, :-1, :, None] + pairs + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        have = np.concatenate([np.einsum("ntf,ntk->fk", x, single).ravel(), joint.sum(axis=(0, 1)).ravel()])
        g = (have - want) / total + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[: width * 2].reshape(width, 2), theta[width * 2 :].reshape(2, 2))


def generated(n: int = 300, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts with known line labels."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(("an", "to", "re", "li", "mor", "sen", "ta", "ver", "ou"), k=rng.randrange(1, 4)))
    sentence = lambda: (" ".join(word() for _ in range(rng.randrange(4, 40))).capitalize() + rng.choice(".......!?"))

    def boiler() -> str:
        k = rng.randrange(6)
        w = [word() for _ in range(rng.randrange(2, 30))]
        return (
            " | ".join(w), " ".join(a + rng.choice(["%%%", "###", "$$$", "&&&", "***"]) for a in w), " ".join(a.upper() + "!!" for a in w),
            " ".join([w[0]] * rng.randrange(8, 40)), rng.choice(["Accept all cookies", "Copyright 2020. All rights reserved", "Log in or sign up", "Click here to subscribe", "Menu", "Read more"]), "<< " + " > ".join(w),
        )[k]

    out = []
    for _ in range(n):
        labels, lines, now = [], [], int(rng.random() < 0.6)
        for _ in range(rng.randrange(1, 16)):
            now = now if rng.random() < 0.8 else 1 - now
            labels.append(now)
            lines.append(sentence() if now else boiler())
        out.append((np.asarray(text_features([x.encode() for x in lines])), np.asarray(labels)))
    return out


def train(docs: DataFrame | None = None, labels: DataFrame | None = None, most: int = SAMPLE) -> Field:
    """A field fitted to generated lines and, where given, at most ``most`` labelled documents."""
    sequences = generated()
    if docs is not None and labels is not None:
        common.small_batches(docs.sparkSession)
        usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
        chosen = usable.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "label").limit(most)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most ``most`` ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [[v for row in text_features(lines_of((t or "").encode())) for v in row] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=["d", "y", "x"])

        for r in sorted(rows.mapInArrow(run, "d long, y int, x array<double>").collect(), key=lambda r: (r.d, r.y, r.x)):
            x = np.asarray(r.x, float).reshape(-1, len(FEATURES))
            for lo in range(0, len(x), SEGMENT):
                sequences.append((x[lo : lo + SEGMENT], np.full(len(x[lo : lo + SEGMENT]), int(r.y > 0))))
    return fit(sequences)


def counts(data: bytes, chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (UTF-8) of so many code points."""
    words = data.split()
    n = len(words)
    gaps = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = lines_of(data)
    repeats = 0
    if n >= 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))  # noqa: B905
        if len(set(grams)) < len(grams):
            count = Counter(grams)
            until = 0
            for i, g in enumerate(grams):
                if count[g] > 1:
                    repeats += i + 5 - max(until, i)
                    until = i + 5
    return n, chars - gaps, symbols, len(lines) - len(set(lines)), repeats


def judge(df: DataFrame, field: Field, text: str = "text", share: float = SHARE) -> DataFrame:
    """Add the base counts, base_failed, content_share (null without lines), line_labels (a digit a line) and kept."""
    common.small_batches(df.sparkSession)
    own = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    own += [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("line_labels", T.StringType()), T.StructField("kept", T.BooleanType())]
    names = {f.name for f in own}
    keep = [f for f in df.schema.fields if f.name not in names]
    at = [f.name for f in keep].index(text)
    schema = T.StructType([*keep, *own])

    def one(t: str | None):
        data = (t or "").encode()
        base = counts(data, len(t or ""))
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        lines = lines_of(data)
        labels = field.viterbi(np.asarray(text_features(lines), float)) if lines else []
        sizes = [len(x.strip()) for x in lines]
        part = sum(s for s, k in zip(sizes, labels, strict=True) if k) / sum(sizes) if lines else None
        return (*base, failed, part, "".join(map(str, labels)), not failed and part is not None and part >= share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.string(), pa.bool_()]
        for b in batches:
            rows = [one(t) for t in b.column(at).to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    field = train(docs, common.table(spark, sf_dir, "labels"))
    return judge(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


QUERIES = {"op5_quality": op5_quality}
