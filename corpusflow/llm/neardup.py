"""3. Near-duplicates by circulant MinHash, with exact verification.

Words are hashed, five consecutive word hashes make a shingle (64 bits), and a document is its set of shingles.  Circulant
MinHash: one permutation scatters the shingles over ``UNIVERSE`` slots; a second one, stored as a table and shifted by one
place for each coordinate, gives all ``COORDINATES`` minima.  Coordinates are banded; documents that share a band are
candidates, and every link is confirmed on the full sets (100 x intersection >= ``percent`` x union).

The steps: (1) documents with equal sets become one representative, so groups of copies of any size cost one row each.
(2) In each band bucket, members are linked to hubs: the smallest member and the member that stands in most buckets,
two pairs a member.  Confirmed links give components.  (3) Buckets whose members still lie in several components are
searched across components: blocks of the bucket are compared by their signatures in numpy, pairs whose signatures agree
well enough are verified on the spot, and a task returns a spanning forest of its links; so no bucket is capped and none
emits its square.  (4) Components by repeated
minimum labels over the verified links, as tables; nothing is collected.

Buckets of ``HOT`` members and more are salted: each join by bucket deals their members out over one task for so many.
A text of more than ``UNIVERSE`` different shingles fills all slots, so such texts share their buckets; they are still told apart
on their full sets.

Defined results: very long texts are hashed whole; null, empty and word-less texts have an empty set and are linked with nothing; fewer than five words are
one shingle; rows that repeat a doc_id are one document in the components (their sets are linked through the id only if
they are similar); a null doc_id stays alone, with a null component, and is kept; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BANDS, ROWS = 21, 6
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20
#: Share of equal coordinates under which a pair in a mixed bucket isn't verified: 5 standard deviations under 0.85.
AGREE = 0.69
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
#: Members of a bucket that one task joins; buckets with more that are told to every task, at most (beyond, that join shuffles).
HOT, MOST_HOT = 256, 200_000

#: Up to so many documents in candidate pairs, their ids are broadcast to the scan of the texts; beyond, that join shuffles.
MOST_IDS = 2_000_000

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables():
    if not _tables.made:
        rng = np.random.default_rng(3)
        byte = rng.integers(0, 2**64, 256, dtype=_U)
        byte[65:91] = byte[97:123]  # A-Z as a-z
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        table = rng.permutation(UNIVERSE).astype(np.int32)
        _tables.made = (byte, space, np.concatenate([table, table[:COORDINATES]]))
    return _tables.made


_tables.made = None


def shingle_hashes(data: bytes) -> np.ndarray:
    """The distinct shingles of a text (UTF-8), sorted."""
    byte, space, _ = _tables()
    b = np.frombuffer(data, np.uint8)
    gap = space[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros(0, _U)
    # a word's hash: the sum of its bytes' random numbers, each times an odd power by its place in the word
    first = np.repeat(starts, ends - starts)
    at = np.flatnonzero(~gap)
    place = (at - first).astype(_U)
    parts = _mix(byte[b[at]] + place * _MULT)
    word = np.add.reduceat(parts, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
    word = _mix(word + (ends - starts).astype(_U))
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, k, dtype=_U)
    for i in range(k):
        out = _mix(out * _MULT + word[i : n - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: the minimum over the set of the second permutation, shifted by the coordinate's number."""
    _, _, table = _tables()
    windows = np.lib.stride_tricks.sliding_window_view(table, COORDINATES)
    slots = np.unique((_mix(shingles + _U(1)) >> _U(44)).astype(np.int64))  # the first permutation
    best = None
    for lo in range(0, len(slots), 4096):
        part = windows[slots[lo : lo + 4096]].min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, digest (of the set; null if empty), sig (coordinates as 32-bit integers)."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            counts, digests, sigs = [], [], []
            for t in _texts(b.column(1)):
                s = shingle_hashes(t)
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).astype("<i4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def bands(reps: DataFrame) -> DataFrame:
    """(bucket, id): the band keys of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, BANDS, ROWS).astype(np.int64).astype(_U)
            key = np.broadcast_to(np.arange(BANDS, dtype=_U), sigs.shape[:2]).copy()
            for r in range(ROWS):
                key = _mix(key * _MULT + sigs[:, :, r])
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    return reps.select("id", "sig").mapInArrow(run, "bucket long, id long")


def set_table(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, s): the sorted shingles of the documents whose ids are asked for; only those texts are read into sets."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(common.broadcast_if_small(common.materialize(ids.distinct(), "ids"), MOST_IDS), "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t).tobytes() for t in _texts(b.column(1))], pa.binary())], names=["id", "s"])

    return common.materialize(texts.mapInArrow(sets, "id long, s binary"), "sets")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two whole sets are similar enough."""
    x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    met = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * met >= percent * (len(x) + len(y) - met)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    held = set_table(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs)
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([similar(x, y, percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that is reachable over the links.

    Each round sends the smallest label along the links, then follows labels to their own labels; the rounds needed grow
    with the logarithm of the longest path.  Every round is a table, so a lost executor costs no more than its part.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links, linked = common.written(links, "links")
    labels, last = common.written(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        # smaller labels cross each link in both directions
        la = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        low = F.least("la", "lb")
        # to the ends of the link and to the labels that the ends have: whole trees move at once
        offers = la.filter("la <> lb").select(F.explode(F.array("a", "b", "la", "lb")).alias("id"), low.alias("offer"))
        best = offers.groupBy("id").agg(F.min("offer").alias("offer"))
        moved = labels.join(best, "id", "left").select("id", F.least("label", F.coalesce("offer", "label")).alias("label"), F.col("label").alias("was"))
        moved, between = common.written(moved, "labels")
        # follow the label's own label
        up = moved.select(F.col("id").alias("label"), F.col("label").alias("top"))
        jumped, now = common.written(moved.join(up, "label", "left").select("id", F.least("label", F.coalesce("top", "label")).alias("label"), "was"), "labels")
        common.drop_made(between, last)  # the next round starts from this one's table
        last = now
        if not jumped.filter("label <> was").limit(1).count():
            break
        labels = jumped.select("id", "label")
    common.drop_made(linked)
    return nodes.select("id").join(jumped.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def salted(rows: DataFrame) -> DataFrame:
    """A row of a bucket (with ``parts``) once for each salt of the bucket."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def across(members: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between components of one bucket; pairs whose signatures disagree aren't compared further.

    A task gives a link only where it ties what its own links don't tie yet, so it returns fewer links than it has members.
    members: bucket, salt, parts, id, label, sig, s.  A bucket's largest component needs no comparison with itself: its members go to
    blocks of their own, the others to blocks before those, about BLOCK members each by a hash of the id.  A task compares
    one block of the others with one block of either kind.
    """
    by = members.groupBy("bucket", "parts", "label").count()
    stats = by.groupBy("bucket", "parts").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("size"))
    cut = lambda n: F.ceil(n / BLOCK).cast("int")
    stats = common.materialize(stats.select("bucket", "parts", "main", cut(F.col("size") - F.col("most")).alias("p"), cut(F.col("most")).alias("q")), "buckets")
    h = F.xxhash64("id")
    block = F.when(F.col("label") == F.col("main"), F.col("p") + F.pmod(h, "q")).otherwise(F.pmod(h, "p")).cast("int")
    placed = members.drop("parts").join(salted(stats), ["bucket", "salt"]).withColumn("block", block)
    # each row goes to the tasks of its block: (i, j) with i among the others' blocks and j not before i
    i_of = F.when(F.col("block") < F.col("p"), F.concat(F.transform(F.sequence("block", F.col("p") + F.col("q") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))), F.transform(F.sequence(F.lit(0), "block"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))))
    i_of = i_of.otherwise(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))))
    rows = placed.withColumn("task", F.explode(F.array_distinct(i_of))).select("bucket", "task.i", "task.j", "block", "id", "label", "sig", "s")
    common.small_batches(members.sparkSession)

    def compare(key, batch):
        _, i, j = (k.as_py() for k in key)
        block = batch.column("block").to_numpy()
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<i4").reshape(-1, COORDINATES)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets = batch.column("s").to_pylist()
        part = np.unique(labels, return_inverse=True)[1]
        up = list(range(int(part.max()) + 1))

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for r in left:
            to = right[(labels[right] != labels[r]) & ((ids[right] > ids[r]) | (i != j))]
            for t in to[(sigs[to] == sigs[r]).sum(axis=1) >= AGREE * COORDINATES]:
                x, y = top(part[r]), top(part[t])
                if x != y and similar(sets[r], sets[t], percent):
                    up[x] = y
                    a.append(min(ids[r], ids[t]))
                    b.append(max(ids[r], ids[t]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id linked, itself included), kept (doc_id = component_id)."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = common.materialize(sketch(docs), "sketches")
    known = rows.filter("doc_id is not null and digest is not null")
    # one row for each different set, under its smallest id (equal sets have equal signatures)
    groups = common.materialize(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "reps")
    # a repeated doc_id may lead several sets: each id once, the sets are tied to it below
    reps = groups.select("id", "sig")
    same = groups.select("digest", F.col("id").alias("rep"))
    table = bands(reps)
    sizes = table.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("low")).filter("size > 1")
    sizes = common.materialize(sizes.withColumn("parts", F.ceil(F.col("size") / HOT).cast("int")), "sizes")
    hot = common.broadcast_if_small(sizes.filter("parts > 1").select("bucket", F.col("parts").alias("over")), MOST_HOT)
    table = table.join(hot, "bucket", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), "over"), F.lit(0)).cast("int")).drop("over")
    shared = common.materialize(table.join(salted(sizes), ["bucket", "salt"]), "buckets")
    # the member that stands in most shared buckets is the likely original of near copies
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    heavy = shared.join(weight, "id").groupBy("bucket", "parts").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    hubs = shared.drop("parts").join(salted(heavy), ["bucket", "salt"]).select("id", F.explode(F.array_distinct(F.array("low", "hub"))).alias("hub")).filter("id <> hub")
    pairs = common.materialize(hubs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
    texts = docs.filter("doc_id is not null")
    first = common.materialize(verified(pairs, texts, percent), "first")
    label = common.materialize(components(reps, first), "components")
    # buckets with members of several components: the other pairs there
    mixed = shared.join(label, "id")
    open_ = mixed.groupBy("bucket", "parts").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket", "parts")
    rest = common.materialize(mixed.filter("size > 2").join(salted(open_).drop("parts"), ["bucket", "salt"], "left_semi").select("bucket", "salt", "parts", "id", "label"), "rest")
    if rest.limit(1).count():
        whole = rest.join(reps, "id").join(set_table(rest.select("id"), texts), "id")
        second = common.materialize(across(whole, percent), "second")
        label = common.materialize(components(reps, first.union(second)), "components")
    final = same.join(label.distinct(), same["rep"] == label["id"]).select("digest", F.col("label").alias("component"))
    # ids that stand on several rows join what their rows are in
    out = rows.join(final, "digest", "left")
    twice = rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count()
    if twice:
        nodes = out.filter("component is not null").select("doc_id", "component").distinct()
        label2 = components(nodes.select(F.col("doc_id").alias("id")).distinct(), nodes.select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
        label2 = label2.select(F.col("id").alias("doc_id"), F.col("label").alias("component"))
        out = out.drop("component").join(label2, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"]))


QUERIES = {"op3_neardup": op3_neardup}
