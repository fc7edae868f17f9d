"""6. Secret scans: certain patterns, and a character convolutional network over every candidate.

The base patterns (assign, access, hex) always count.  High-recall generators propose more: tokens with digits and mixed
letters, well-known prefixes, passwords inside addresses, private key blocks.  A small network in numpy reads each candidate,
whole, with the characters around it: embedded characters and places, one convolution, maximum and mean over all places, a
logistic output.  Candidates that touch a base span are scored like any; one that is accepted is added unless it lies within
a base span or touches an added one.

The network learns labelled findings of the table itself and generated ones.  Of the table, at most ``SAMPLE`` different texts
teach (those with the smallest hashes): a candidate that touches a base span is a secret, another token that touches none of
a telling form is no secret, the rest teach nothing.  Generated findings (keys, tokens and passwords against digests, identifiers,
file names, numbers, long words, encoded images) stand half in contexts taken from the table.  A fourth of
the texts, and of the generated findings, is held out for calibration.  The threshold is the largest margin that still
reaches a recall of ``RECALL`` on held-out secrets, or less where a calibrated score of ``SURE`` begins before it.

A candidate has no greatest length.  Least lengths: 16 for a token, 12 after a prefix, 4 for a password in an address, 16 in
a key block.

Defined results: null and empty texts have no spans; very long texts and candidates are read whole, in pieces of ``PIECE``
characters; places are code points, end exclusive; repeated rows each get their own result; an empty table gives no rows
(the network then knows generated findings only); other columns pass through, those named like an output column are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gbt

KINDS = ("assign", "access", "hex", "other")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Words without which ASSIGN can't match.
NEEDS = ("passw", "secret", "token", "api")

#: Runs go to their end, however long; possessive quantifiers keep each scan in proportion to the text.
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+")
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|xox[abprs]-|sk-|pk_|rk_|glpat-|eyJ|AIza)[A-Za-z0-9._-]{12,}+")
IN_ADDRESS = re.compile(r"(?<=://)[^\s/:@]++:([^\s/:@]{4,}+)@")
NAME = r"(?:(?!PRIVATE KEY-----)[A-Z ])*+PRIVATE KEY-----"
BLOCK = re.compile(rf"-----BEGIN {NAME}[A-Za-z0-9+/=\s]{{16,}}+-----END {NAME}")

RECALL, SURE = 0.97, 0.9
#: Different texts of the table that teach, at most; their findings, at most, and the longest of those (in teaching only).
SAMPLE, FINDINGS, TAUGHT_CHARS = 20_000, 6000, 2048
#: Characters of context before and after; places told apart at a candidate's head and tail.
BEFORE, AFTER, HEAD, TAIL = 20, 8, 12, 6
PLACES = BEFORE + HEAD + 1 + TAIL + AFTER
CHARS, CODE, FILTERS, SPAN = 100, 8, 24, 5
#: Characters that go through the network together; a longer candidate goes in several pieces.
PIECE = 1 << 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in NEEDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def telling(text: str) -> set[tuple[int, int]]:
    """Candidates whose form alone says what they may be."""
    out: set[tuple[int, int]] = set()
    if any(p in text for p in ("_", "-", "eyJ", "AIza")):
        out |= {m.span() for m in PREFIXED.finditer(text)}
    if "://" in text:
        out |= {m.span(1) for m in IN_ADDRESS.finditer(text)}
    if "PRIVATE KEY" in text:
        out |= {m.span() for m in BLOCK.finditer(text)}
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return sorted({m.span() for m in MIXED.finditer(text)} | telling(text), key=lambda s: (s[0], -s[1]))


def encode(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Character and place numbers of a whole candidate and what surrounds it."""
    left, size = min(BEFORE, start), end - start
    points = np.frombuffer(text[start - left : end + AFTER].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    chars = np.where(points < 32, 98, np.where(points < 127, points - 30, 99))
    i = np.arange(len(points)) - left
    inside = np.where(i < HEAD, BEFORE + i, np.where(size - 1 - i < TAIL, BEFORE + HEAD + 1 + size - 1 - i, BEFORE + HEAD))
    return chars, np.where(i < 0, BEFORE + i, np.where(i < size, inside, PLACES - AFTER + i - size))


class Net:
    """Embedding, convolution, maximum and mean over any number of places, logistic output; trained by Adam.

    Candidates lie one behind the other with ``SPAN - 1`` empty places between, so no window sees two of them.
    """

    def __init__(self, seed: int = 6):
        r = np.random.default_rng(seed)
        f = lambda *s, k: r.normal(0, k, s).astype(np.float32)
        self.p = [f(CHARS, CODE, k=0.5), f(PLACES, CODE, k=0.1), f(SPAN, CODE, FILTERS, k=0.15), np.zeros(FILTERS, np.float32), f(2 * FILTERS + 2, k=0.2)]

    @staticmethod
    def lay(rows: list[tuple[np.ndarray, np.ndarray]]):
        """Characters, places, which places are real, and where each row begins."""
        gap = np.zeros(SPAN - 1, np.int64)
        x = np.concatenate([a for c, _ in rows for a in (c, gap)])
        place = np.concatenate([a for _, k in rows for a in (k, gap)])
        sizes = np.asarray([len(c) for c, _ in rows])
        starts = np.concatenate([[0], np.cumsum(sizes + SPAN - 1)[:-1]])
        real = np.ones(len(x), np.float32)
        for k in range(SPAN - 1):
            real[starts + sizes + k] = 0
        return x, place, real[:, None], starts, sizes

    def convolve(self, x: np.ndarray, place: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        emb, at, conv, bias, _ = self.p
        e = np.concatenate([(emb[x] + at[place]) * real, np.zeros((SPAN - 1, CODE), np.float32)])
        h = bias + sum(e[k : k + len(x)] @ conv[k] for k in range(SPAN))
        return e, np.maximum(h, 0) * real

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One number for each candidate; pieces of a long one overlap, so each window is seen once."""
        most, total, size = np.zeros((len(rows), FILTERS), np.float32), np.zeros((len(rows), FILTERS)), np.asarray([len(c) for c, _ in rows])
        pieces = [(i, lo) for i, n in enumerate(size) for lo in range(0, n, PIECE)]
        while pieces:
            held = 0
            for n, (i, _) in enumerate(pieces, 1):  # noqa: B007
                held += min(PIECE, size[i])
                if held >= PIECE:
                    break
            part, pieces = pieces[:n], pieces[n:]
            x, place, real, starts, sizes = self.lay([tuple(a[lo : lo + PIECE + SPAN - 1] for a in rows[i]) for i, lo in part])
            _, h = self.convolve(x, place, real)
            for (i, lo), s, k in zip(part, starts, sizes, strict=True):
                own = h[s : s + min(k, PIECE)]
                most[i] = np.maximum(most[i], own.max(axis=0))
                total[i] += own.sum(axis=0)
        return self.pooled(most, total, size) @ self.p[4] if len(rows) else np.zeros(0)

    @staticmethod
    def pooled(most: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = size[:, None].astype(np.float32)
        return np.concatenate([most, total.astype(np.float32) / n, np.log(n) / 8, np.ones_like(n)], axis=1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.01) -> None:
        r = np.random.default_rng(1)
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for lo in range(0, len(rows), size):
                b = order[lo : lo + size]
                x, place, real, starts, sizes = self.lay([rows[i] for i in b])
                e, h = self.convolve(x, place, real)
                most = np.maximum.reduceat(h, starts)
                pooled = self.pooled(most, np.add.reduceat(h, starts), sizes)
                z = pooled @ self.p[4]
                dz = ((1 / (1 + np.exp(-z)) - y[b]) / len(b)).astype(np.float32)
                dp = dz[:, None] * self.p[4]
                wide = np.repeat(np.arange(len(b)), sizes + SPAN - 1)
                dh = (dp[:, FILTERS : 2 * FILTERS] / sizes[:, None])[wide] + np.where(h == most[wide], dp[:, :FILTERS][wide], 0)
                dh = (dh * (h > 0)).astype(np.float32)
                de = np.zeros_like(e)
                for k in range(SPAN):
                    de[k : k + len(x)] += dh @ self.p[2][k].T
                de = de[: len(x)] * real
                g = [np.zeros_like(p) for p in self.p[:2]]
                np.add.at(g[0], x, de)
                np.add.at(g[1], place, de)
                g += [np.stack([e[k : k + len(x)].T @ dh for k in range(SPAN)]), dh.sum(axis=0), pooled.T @ dz]
                t += 1
                for k, d in enumerate(g):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def labelled(n: int = 2400, seed: int = 6, contexts: list[tuple[str, str]] | None = None) -> list[tuple[str, int, int, int]]:
    """Generated findings: text, start, end, label; half of them stand in ``contexts`` (before, after) where there are any."""
    rng = random.Random(seed)
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda a, k: "".join(rng.choices(a, k=k))
    word = lambda: rng.choice(["the", "in", "der", "und", "que", "les", "with", "server", "file", "tion", "ing", "user", "see", "commit", "page", "id", "ref"])
    out = []
    for _ in range(n):
        secret = rng.random() < 0.5
        before, after = " ".join(word() for _ in range(rng.randrange(4))) + " ", " " + word()
        if secret:
            s, cue = rng.choice([
                (pick(up + low + dig + "+/", 40), ["aws_secret ", "key: ", 'auth "', "credentials="]), ("ghp_" + pick(up + low + dig, 36), ["", "git ", "use "]),
                ("sk-" + pick(up + low + dig, rng.randrange(24, 50)), ["", "key ", "openai: "]), ("xoxb-" + pick(dig, 11) + "-" + pick(up + low + dig, 24), ["", "slack "]),
                ("eyJ" + pick(up + low + dig, 20) + "." + pick(up + low + dig + "-_", 40), ["Bearer ", "jwt ", "Authorization: "]), ("AIza" + pick(up + low + dig + "-_", 35), ["", "maps key "]),
                (pick(up + low + dig + "!#%", rng.randrange(8, 16)), ["https://admin:", "ftp://bob:", "postgres://root:"]), (pick(up + low + dig, rng.randrange(20, 33)), ["key=", "pwd: ", "auth_key ", "private "]),
                ("-----BEGIN RSA PRIVATE KEY-----\n" + pick(up + low + dig + "+/", 120) + "\n-----END RSA PRIVATE KEY-----", ["", "key:\n"]),
            ])
            before += rng.choice(cue)
            if "://" in before:
                after = "@host" + after
        else:
            s = rng.choice([
                pick(low, rng.randrange(12, 24)) + pick(dig, 2), "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), pick(dig, rng.randrange(16, 26)),
                "/".join(pick(low, 6) for _ in range(3)) + "/" + pick(low, 5) + pick(dig, 2), "_".join(pick(low, 5) for _ in range(3)) + "_" + pick(dig, 3), pick(low, 5).capitalize() + pick(low, 6).capitalize() + "Version" + pick(dig, 2),
                pick(up, 8) + "-" + pick(dig, 4) + "-" + pick(up, 6), "2024-05-17-" + pick(low, 8) + "-" + pick(dig, 4), "=" * 12 + pick(dig, 6), "iVBORw0KGgo" + pick(up + low + dig + "+/", rng.randrange(40, 900)), pick("0123456789abcdef", 40)[:40], pick(dig, 16), pick(dig, 16), pick("ACGT", 30) + pick(dig, 1), "isbn-" + pick(dig, 13), pick(up, 2) + pick(dig, 18),
            ])
            before += "data:image/png;base64," if s.startswith("iVBOR") else rng.choice(["commit ", "file ", "id ", "see ", "order ", "", "", "path ", "sha1:", "digest "])
        if contexts and rng.random() < 0.5 and "://" not in before and not s.startswith("iVBOR"):
            before, after = rng.choice(contexts)
        out.append((before + s + after, len(before), len(before) + len(s), int(secret)))
    return out


def touching(span: tuple[int, int], spans) -> bool:
    return any(span[0] < x[1] and x[0] < span[1] for x in spans)


def findings(df: DataFrame, text: str = "text", most: int = SAMPLE) -> list:
    """Rows (text around, start, end, label, held) of at most ``FINDINGS`` candidates in ``most`` different texts of the table."""
    common.small_batches(df.sparkSession)
    own = df.select(F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null")
    hashed = own.select("t", F.xxhash64(F.lit(6), "t").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return []
    # copies of a text are one: what is kept is bounded however often it occurs
    sample = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, told = base_spans(t), telling(t)
                for a, e in candidates(t):
                    label = touching((a, e), base)
                    if e - a <= TAUGHT_CHARS and (label or not touching((a, e), told)):
                        left = max(0, a - BEFORE)
                        out.append((t[left : e + AFTER], a - left, e - left, int(label), h % 4 == 0))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "start", "end", "label", "held"])

    found = sample.mapInArrow(run, "text string, start int, end int, label int, held boolean").distinct()
    by = F.xxhash64("text", "start")
    return found.orderBy(by, "text", "start", "end").limit(FINDINGS).collect()


class Model:
    """The network, the margin from which a candidate counts, and how the held-out part fares there."""

    def __init__(self, rows: list[tuple[str, int, int, int, bool]]):
        x = [encode(t, a, b) for t, a, b, _, _ in rows]
        y = np.asarray([r[3] for r in rows], np.float32)
        held = np.asarray([r[4] for r in rows], bool)
        self.net = Net()
        self.net.fit([v for v, h in zip(x, held, strict=True) if not h], y[~held])
        m, true = self.net.margin([v for v, h in zip(x, held, strict=True) if h]), y[held] > 0.5
        self.knots, self.levels = gbt.isotonic(m, y[held])
        sure = self.knots[self.levels >= SURE]
        self.least = float(min(np.quantile(m[true], 1 - RECALL, method="lower"), sure.min() if len(sure) else np.inf))
        said = m >= self.least
        self.recall, self.precision = float((said & true).sum() / true.sum()), float((said & true).sum() / max(1, said.sum()))

    def score(self, margins: np.ndarray) -> np.ndarray:
        """Calibrated: how often a candidate with this margin is a secret."""
        return np.interp(margins, self.knots, self.levels)


@lru_cache(maxsize=1)
def generated_model() -> Model:
    return Model([(*r, i % 4 == 0) for i, r in enumerate(labelled())])


def train(df: DataFrame, text: str = "text", most: int = SAMPLE) -> Model:
    """A model for a table: its own findings and generated ones."""
    rows = [tuple(r) for r in findings(df, text, most)]
    if not rows:
        return generated_model()
    contexts = {h: [(t[:a], t[e:]) for t, a, e, label, held in rows if held == h and not label] for h in (False, True)}
    made = [(*r, False) for r in labelled(1800, 6, contexts[False])] + [(*r, True) for r in labelled(600, 66, contexts[True])]
    return Model(rows + made)


def scan(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (kind, start, end) by start, then kind as listed; spans holds base."""
    common.small_batches(df.sparkSession)
    model = model or train(df, text)
    net, least = model.net, model.least
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    keep = [f for f in df.schema.fields if f.name not in ("base", "spans")]
    at = [f.name for f in keep].index(text)
    schema = T.StructType([*keep, T.StructField("base", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        for b in batches:
            base, more, rows = [], [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                base.append(base_spans(t) if t else [])
                for a, e in candidates(t) if t else ():
                    more.append((i, a, e))
                    rows.append(encode(t, a, e))
            spans = [list(x) for x in base]
            ends = [0] * len(spans)  # of the last added one: candidates come from left to right
            for (i, a, e), m in zip(more, net.margin(rows), strict=True):
                if m >= least and a >= ends[i] and not any(x[0] <= a and e <= x[1] for x in base[i]):
                    spans[i].append((a, e, "other"))
                    ends[i] = e
            for x in spans:
                x.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([row(x) for x in base], kind), pa.array([row(x) for x in spans], kind)], names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text, spans) -> F.Column:
    """The text with each span replaced by its kind in brackets; one that begins inside an earlier one lengthens that."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        inside = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
