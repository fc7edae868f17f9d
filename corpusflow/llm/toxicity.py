"""4. Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features: densities of a lexicon learned from the labels, how near its words stand to the second person, capitals,
punctuation, and obfuscation (signs or digits inside words, and lexicon words that appear once those are undone).

Learning uses only labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``SAMPLE`` of them (in the order of a
hash of the id; every label where there are fewer).  Calibration is cross-fitted: the sample is dealt into ``FOLDS`` parts by a
hash of the text, so copies stay together; each part gets margins from a lexicon and trees that haven't seen it, and the
isotonic levels are those of all these margins.  The lexicon and the trees that score learn from the whole sample.  Word
counts are summed on the executors, a lexicon has at most ``LEXICON`` words, and the driver gets the lexicons and the sample's
dense features: sizes that the input doesn't move.  Labels, language, source and ids never enter a score.  Scoring reads
every whole text; letter case is that of Unicode.

Defined results: null, empty and word-less texts are scored like any (all features 0), very long ones as a whole; rows without a label, or with a null
label or doc_id, teach nothing; with no usable labels, or labels of one kind, every score is that share of ones (0 without
any); repeated rows each get their score; an empty table gives no rows; other columns pass through ``classify``, those named
like its outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gbt

#: Labelled rows that are learned from, at most; words in the lexicon, at most; parts for calibration.
SAMPLE, LEXICON, FOLDS = 12_000, 256, 5
#: Words this near to a second-person word are counted as addressed to somebody.
NEAR = 6
YOU = frozenset(x.encode() for x in "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes tú ti tuyo vosotros vuestro".split())
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Marks around words become spaces; those that stand for letters stay until words are cut.
_PLAIN = bytes.maketrans(bytes(c for c in _SIGNS if c not in b"@$!*'"), b" " * (len(_SIGNS) - 5))
_UNDO = bytes.maketrans(b"@$!013457", b"asioieast")
_HIDDEN = re.compile(rb"[a-z][@$!*0-9]+[a-z]")
FEATURES = ("hits", "distinct", "density", "weight", "strongest", "near_you", "undone", "hidden", "capitals", "loud", "marks", "signs", "figures", "words")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What a character is: 1 capital, 2 other letter, 3 shout, 4 sign, 5 digit; code points from 65,535 on share an entry."""
    out = np.zeros(1 << 16, np.int64)
    for o in range(128, (1 << 16) - 1):
        c = chr(o)
        out[o] = 1 if c.isupper() else 2 if c.isalpha() else 0
    out[65:91], out[97:123], out[48:58] = 1, 2, 5
    out[[*_SIGNS]] = 4
    out[[*b"!?"]] = 3
    return out


def words_of(text: str) -> list[bytes]:
    return [w.strip(b"@$!*'") for w in text.lower().encode().translate(_PLAIN).split()]


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    text = text or ""
    low = text.lower().encode()
    words = [w.strip(b"@$!*'") for w in low.translate(_PLAIN).split()]
    n = max(1, len(words))
    at = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in at]
    undone = hidden = 0
    if _HIDDEN.search(low):
        for w in words:
            if _HIDDEN.search(w):
                hidden += 1
                undone += w.translate(_UNDO) in lexicon or w.replace(b"*", b"") in lexicon
    you = [i for i, w in enumerate(words) if w in YOU] if at else []
    near = 0
    if you:
        places = np.asarray(you)
        k = np.searchsorted(places, at)
        gap = np.minimum(np.abs(places[np.minimum(k, len(places) - 1)] - at), np.abs(places[np.maximum(k - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0xFFFF)
    kinds = np.bincount(_kinds()[points], minlength=6) if text else np.zeros(6)
    size, letters = max(1, len(text)), max(1, kinds[1] + kinds[2])
    return [
        len(at), len({words[i] for i in at}), len(at) / n, sum(weights) / n, max(weights, default=0.0), near / n,
        undone / n, hidden / n, kinds[1] / letters, float(kinds[1] > 0.6 * letters), kinds[3] / size, kinds[4] / size, kinds[5] / size, float(np.log1p(len(words))),
    ]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, label, fold): a bounded sample of the labelled rows that may teach, as a table."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("label")).filter((fold != 0) & F.col("label").isNotNull())
    chosen = usable.orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id", "label").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``most`` ids: the bound is the parameter
    return common.materialize(texts.join(F.broadcast(chosen), "doc_id").select("text", "label", F.pmod(F.xxhash64(F.lit(44), "text"), F.lit(FOLDS)).cast("int").alias("fold")), "toxic")


def learn_lexicons(rows: DataFrame, size: int = LEXICON) -> list[dict[bytes, float]]:
    """Words that toxic texts have far more often, with their log ratio: without each fold in turn, then of all rows.

    Counts are summed on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, int], list[int]] = {}
        for b in batches:
            for t, y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for w in set(words_of(t or "")):
                    if len(w) > 1:
                        counts.setdefault((w, f), [0, 0])[int(y > 0.5)] += 1
            if len(counts) > 200_000:
                yield batch(counts)
                counts = {}
        yield batch(counts)

    def batch(counts):
        columns = [pa.array([k[0] for k in counts], pa.binary()), pa.array([k[1] for k in counts], pa.int32())]
        columns += [pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "fold", "clean", "toxic"])

    counted = rows.select("text", "label", "fold").mapInArrow(run, "word binary, fold int, clean long, toxic long")
    part = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in ("clean", "toxic") for f in range(FOLDS)]
    words = common.materialize(counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), *part), "words")
    sizes = {r.fold: (r.toxic, r.all - r.toxic) for r in rows.groupBy("fold").agg(F.sum(F.when(F.col("label") > 0.5, 1).otherwise(0)).alias("toxic"), F.count("*").alias("all")).collect()}
    out = []
    for f in range(FOLDS + 1):
        toxic, clean = (sum(v[i] for k, v in sizes.items() if k != f) for i in (0, 1))
        if not toxic or not clean:
            out.append({})
            continue
        t, c = (F.col(k) - F.col(f"{k}_{f}") if f < FOLDS else F.col(k) for k in ("toxic", "clean"))
        ratio = F.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))
        rated = words.filter(t >= max(3, toxic // 200)).select("word", t.alias("toxic"), ratio.alias("ratio")).filter(F.col("ratio") > 1.5)
        top = rated.orderBy((F.col("ratio") * F.col("toxic")).desc(), "word").limit(size).collect()  # the lexicon's size
        out.append({bytes(r.word): float(r.ratio) for r in top})
    return out


class Model:
    def __init__(self, lexicon: dict[bytes, float], trees: gbt.Boosted | None, share: float):
        self.lexicon, self.trees, self.share = lexicon, trees, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        return np.clip(self.trees.predict(np.asarray([features(t, self.lexicon) for t in texts], float)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    common.small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, most)
    lexicons = learn_lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[features(t, lexicon) for lexicon in lexicons] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.list_(pa.float64()))), b.column(1), b.column(2)], names=["x", "y", "fold"])

    got = rows.mapInArrow(run, "x array<array<double>>, y double, fold int").collect()  # at most ``most`` rows of a few numbers
    got.sort(key=lambda r: (r.x, r.y, r.fold))
    y, fold = np.asarray([r.y > 0.5 for r in got], float), np.asarray([r.fold for r in got], int)
    if not len(y) or y.min() == y.max():
        return Model(lexicons[-1], None, float(y.mean()) if len(y) else 0.0)
    x = np.asarray([r.x for r in got], float)
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        part = fold == f
        if part.any():
            unseen[part] = gbt.fit(x[~part, f], y[~part], rounds=40, depth=3).margin(x[part, f])
    trees = gbt.fit(x[:, -1], y, rounds=40, depth=3)
    trees.knots, trees.levels = gbt.isotonic(unseen, y)
    return Model(lexicons[-1], trees, float(y.mean()))


def classify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (double) and ``predicted`` (int) to each row."""
    common.small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    at = [f.name for f in keep].index(text)
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    model = train(docs, common.table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return classify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
