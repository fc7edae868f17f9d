"""2. Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

Sources are the read partitions.  Each row gets a random key and its rank within its own source (the local permutation;
nothing moves).  From the sources' row counts and the exact shard sizes the driver draws
how many rows each source sends to each shard: row by row from the multivariate hypergeometric law, which is the law
that a uniform permutation of all rows induces.  A row's rank tells its shard.  After the exchange the rows of a shard are
permuted again, in slabs of the second random key, and numbered without gaps.

The matrix holds sources x shards counts: the driver sees one number for each read partition.  It is broadcast up to
``MOST_SOURCES`` sources (read partitions of 128 MB: 100 TB and more), beyond that joined.  No key of the data decides where a row goes,
so no key can be hot.

Random keys are hashes of the seed and the row, so a task that is run again draws the same; the ranks are written to the
shared folder before the counts are taken, so both agree even if the input is split otherwise later.

Defined results: nulls in any column are hashed as such; a null text has size 1 (no bytes plus 1) and the checksum of the
empty text; a very long text is one row like any other, only its size and checksum travel in ``op2``; rows that are equal in
everything are interchangeable and each gets a slot of its own; an empty table gives no rows; extra columns play no part in
``op2``, and ``shard`` keeps those asked for.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Sources whose matrix is broadcast; sources in one literal of the plan.
MOST_SOURCES, CHUNK = 1_000_000, 8192
#: Rows of a slab, about; slabs of a shard are permuted and numbered apart.
SLAB_ROWS = 500_000
#: Populations for which numpy's generator is defined.
NUMPY_MOST = 10**9


def shard_sizes(n: int, shards: int) -> list[int]:
    """Row counts at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each source sends to each shard: a draw from the law of a uniform shuffle.

    Row sums are ``counts`` and column sums are ``sizes``, exactly.
    """
    if sum(counts) != sum(sizes):
        raise ValueError("sources and shards must hold the same number of rows")
    rng, left = np.random.default_rng(seed), np.asarray(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest = int(left.sum())
        for s in range(len(sizes)):  # one conditional draw after the other: any population size
            rest -= int(left[s])
            need = n - int(out[p, :s].sum())
            out[p, s] = need if rest == 0 else _hypergeometric(rng, int(left[s]), rest, need)
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    return _hypergeometric_large(rng, good, bad, draws)


def _log_ratio(a: int, d: int) -> float:
    """log((a + d)! / a!) - d log a, without the loss of digits that two large logarithms of factorials would bring."""
    if a < 10**6 or 2 * abs(d) > a:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1) - d * math.log(max(a, 1))
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3)  # noqa: E731  of Stirling's series
    return (a + d + 0.5) * math.log1p(d / a) - d + tail(a + d) - tail(a)


def _hypergeometric_large(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A draw for any population, by rejection from a ratio of uniforms around the mode (Stadlober's hat for laws of this kind).

    Only ratios of probabilities are needed; those come from differences of logarithms near the mode.
    """
    n = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(max((draws + 1) * (good + 1) // (n + 2), lo), hi)
    mean = draws * good / n
    var = mean * (bad / n) * ((n - draws) / (n - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    parts = (mode, good - mode, draws - mode, bad - draws + mode)
    up, down = max(parts[1], 1) * max(parts[2], 1), max(parts[0], 1) * max(parts[3], 1)
    slope = math.log1p((up - down) / down)  # of the four d log a together, from whole numbers
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = mean + 0.5 + width * (v - 0.5) / u
        if not lo <= x < hi + 1:
            continue
        d = math.floor(x) - mode
        log_p = d * slope - sum(_log_ratio(a, s * d) for a, s in zip(parts, (1, -1, -1, 1), strict=True))
        if 2 * math.log(u) <= log_p:
            return mode + d


def _plan(spark: SparkSession, order: list[int], begins: list[list[int]]) -> DataFrame:
    """(__source, __b): the matrix as rows; a long one is written in pieces, so no literal grows with the input."""

    def piece(lo: int) -> DataFrame:
        said = json.dumps([{"p": p, "b": b} for p, b in zip(order[lo : lo + CHUNK], begins[lo : lo + CHUNK], strict=True)])
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(said), "array<struct<p:bigint,b:array<bigint>>>")).alias("x"))
        return rows.select(F.col("x.p").alias("__source"), F.col("x.b").alias("__b"))

    first = piece(0)
    if len(order) <= CHUNK:
        return first
    path = common.new_path(spark, "matrix")
    for lo in range(0, len(order), CHUNK):
        piece(lo).write.mode("append").parquet(path)
    return spark.read.schema(first.schema).parquet(path)


def shard(df: DataFrame, shards: int = 16, seed: int = 20, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` (``columns`` of it) with ``shard`` (0 to shards - 1) and ``slot`` (from 0, gapless in a shard)."""
    spark = df.sparkSession
    rows = common.narrow(df, columns or df.columns)
    names = rows.columns
    if clash := {"shard", "slot"} & set(names):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    whole = [F.col(f"`{c}`") for c in names]
    # the local permutation: ranks by a random key, where the rows are
    keyed = rows.withColumn("__at", F.monotonically_increasing_id()).select(*whole, F.xxhash64(F.lit(seed), *whole, "__at").alias("__k1"))
    ranked = keyed.sortWithinPartitions("__k1", *whole).withColumn("__m", F.monotonically_increasing_id())
    ranked = common.materialize(
        ranked.select(*whole, F.shiftright("__m", 33).alias("__source"), F.col("__m").bitwiseAND((1 << 33) - 1).alias("__rank")), "sharding"
    )
    counts = {r[0]: r[1] for r in ranked.groupBy("__source").count().collect()}  # one number for each source
    order = sorted(counts)
    n = sum(counts.values())
    sizes = shard_sizes(n, shards)
    matrix = communication_matrix([counts[p] for p in order], sizes, seed)
    # for each source: where in its ranks each shard begins
    begins = np.concatenate([np.zeros((len(order), 1), np.int64), matrix.cumsum(axis=1)[:, :-1]], axis=1).tolist()
    plan = _plan(spark, order, begins)
    # one row of ``shards`` numbers for each read partition
    plan = F.broadcast(plan) if len(order) <= MOST_SOURCES else plan
    placed = ranked.join(plan, "__source").withColumn("shard", (F.size(F.filter("__b", lambda b: b <= F.col("__rank"))) - 1).cast("int"))
    slabs = max(16, -(-n // (shards * SLAB_ROWS)))
    k2 = F.xxhash64(F.lit(seed + 1), *whole, F.col("__source"), F.col("__rank"))
    placed = placed.select(*whole, "shard", k2.alias("__k2")).withColumn("__slab", F.pmod(F.shiftright("__k2", 20), F.lit(slabs)).cast("int"))
    # the second permutation: slabs in order, random keys within
    w = Window.partitionBy("shard").orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("shard", "__slab").count().withColumn("__before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    within = Window.partitionBy("shard", "__slab").orderBy("__k2", *whole)
    numbered = placed.withColumn("__n", F.row_number().over(within))
    out = numbered.join(heads.select("shard", "__slab", "__before"), ["shard", "__slab"])
    return out.select(*whole, "shard", (F.col("__before") + F.col("__n") - 1).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )


QUERIES = {"op2_sharding": op2_sharding}
