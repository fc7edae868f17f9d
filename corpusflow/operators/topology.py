"""Chunks as a functional graph: order edges, sections, attractors, hops, cohesion, capped similarity edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .tables import table

SECTION = 20
#: How many of a node's nearest each pass of the virtual edges looks at.
PASSES = (32, 64, 128)


def _order():
    return Window.partitionBy("source").orderBy("chunk_index", "id")


def sequence_edges(chunks: DataFrame) -> DataFrame:
    """src, dst, weight, type between neighbours of a source; sources without a name are one."""
    named = chunks.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("_anon"))) if dict(chunks.dtypes)["source"] == "string" else chunks
    return named.select("id", F.lead("id").over(_order()).alias("dst")).filter("dst is not null").select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"), F.lit("sequential").alias("type"))


def fixed_sections(chunks: DataFrame, size: int = SECTION) -> DataFrame:
    """Each chunk with place, successor (the chunk before it in its section), basin_id (the section's first chunk) and hops."""
    placed = chunks.withColumn("place", F.row_number().over(_order()) - 1)
    return _sections(placed.withColumn("starts", F.col("place") % size == 0))


def _sections(placed: DataFrame) -> DataFrame:
    w = _order()
    start = F.last(F.when(F.col("starts"), F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.max(F.when(F.col("starts"), F.col("place"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("successor", F.when(~F.col("starts"), F.lag("id").over(w)))
    return out.withColumn("basin_id", start).withColumn("hops", (F.col("place") - at).cast("int")).drop("starts")


def adaptive_sections(chunks: DataFrame, threshold: float = 0.55, longest: int = SECTION + 10, shortest: int = 3) -> DataFrame:
    """Sections that end where the similarity to the chunk before drops, or at ``longest``.

    Whether a chunk starts a section depends on the last start, so the fold over a source's similarities is one array
    expression a source.  A missing vector never starts one, a zero vector is similar to nothing.  chunks need ``vector``.
    """
    w = _order()
    before = F.lag("vector").over(w)
    sim = F.when(before.isNull() | F.col("vector").isNull(), F.lit(None)).otherwise(X.cosine(before, F.col("vector")))
    placed = chunks.withColumn("place", F.row_number().over(w) - 1).withColumn("sim", sim)
    folded = placed.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sim"))), lambda x: x["sim"]).alias("sims"))

    def step(acc, i):
        gap = i - F.element_at(acc, -1)
        s = F.element_at(F.col("sims"), i + 1)
        return F.when((gap >= longest) | ((gap >= shortest) & F.coalesce(s < threshold, F.lit(False))), F.array_append(acc, i)).otherwise(acc)

    rest = F.when(F.size("sims") > 1, F.sequence(F.lit(1), F.size("sims") - 1)).otherwise(F.array().cast("array<int>"))
    starts = folded.select("source", F.explode(F.aggregate(rest, F.array(F.lit(0)), step)).alias("place")).withColumn("starts", F.lit(True))
    return _sections(placed.drop("sim").join(starts, ["source", "place"], "left").withColumn("starts", F.coalesce("starts", F.lit(False))))


def attractors(successors: DataFrame) -> DataFrame:
    """node, attractor, hops for any successor map (node, next or null): pointers double until nothing moves.

    Chains end at a sink or at a next that has no row (it becomes a node of its own); a cycle's smallest node stands for it.
    """
    known = successors.select("node", "next")
    loose = known.select(F.col("next").alias("node")).filter("node is not null").distinct().join(known, "node", "left_anti")
    nodes = table(known.unionByName(loose.withColumn("next", F.lit(None).cast(dict(known.dtypes)["next"]))))
    # jump: where 2^k steps lead (sinks stay); low: the smallest node on the way
    state = table(nodes.select("node", F.coalesce("next", "node").alias("jump"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("steps"), F.least("node", F.coalesce("next", "node")).alias("low")))
    n, k = nodes.count(), 1
    while k <= n:  # log2(n) rounds
        b = state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        state = table(state.join(b, "jump").select("node", F.col("jump2").alias("jump"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", "low2").alias("low")))
        k *= 2
        if not nodes.filter("next is not null").join(state, "node").join(nodes.select(F.col("node").alias("jump"), F.col("next").alias("after")), "jump").filter("after is not null").limit(1).count():
            break
    ends = nodes.filter("next is null").select(F.col("node").alias("jump"), F.lit(True).alias("sink"))
    whole = state.join(ends, "jump", "left")
    # after more steps than nodes, a pointer that is on no sink is on a cycle, and low of that place is the cycle's smallest
    cycle = whole.filter("sink is null").select("node", "jump").join(state.select(F.col("node").alias("jump"), F.col("low").alias("least")), "jump").select("node", "least")
    out = whole.join(cycle, "node", "left").select("node", F.coalesce("least", "jump").alias("attractor"), F.when(F.col("sink"), F.col("steps")).alias("hops"))
    if not cycle.limit(1).count():
        return out.withColumn("hops", F.col("hops").cast("int"))
    return _cycle_hops(table(out), nodes)


def _cycle_hops(out: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hops in basins with a cycle: breadth first from the attractor against the successors."""
    front = out.filter("hops is null and node = attractor").select("node").withColumn("hops", F.lit(0))
    found, depth = front, 0
    while True:
        depth += 1
        nxt = nodes.join(front.select(F.col("node").alias("next")), "next").select("node").join(found, "node", "left_anti").withColumn("hops", F.lit(depth))
        front = table(nxt)
        if not front.limit(1).count():
            break
        found = table(found.unionByName(front))
    return out.join(found.withColumnRenamed("hops", "more"), "node", "left").select("node", "attractor", F.coalesce("hops", "more", F.lit(0)).cast("int").alias("hops"))


def members(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("basin_id").agg(F.count("*").alias("n_members"), F.max("hops").alias("depth"))


def tree_edges(chunks: DataFrame) -> DataFrame:
    """basin_id, parent, child: a chunk hangs on its successor when both share a basin."""
    up = chunks.select(F.col("id").alias("successor"), F.col("basin_id").alias("up"))
    return chunks.join(up, "successor").filter("up = basin_id").select("basin_id", F.col("successor").alias("parent"), F.col("id").alias("child"))


def cohesion(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Weight of edges inside a basin over all that touch it (inside counts from both ends), 2 digits; 1 without edges."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    a = chunks.select(F.col("id").alias("src"), F.col("basin_id").alias("a"))
    b = chunks.select(F.col("id").alias("dst"), F.col("basin_id").alias("b"))
    met = both.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("basin_id")).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("all"))
    sizes = chunks.groupBy("basin_id").agg(F.count("*").alias("n"))
    value = F.when((F.col("n") == 1) | F.coalesce(F.col("all") == 0, F.lit(True)), 1.0).otherwise(F.bround(F.col("inside") / F.col("all"), 2))
    return sizes.join(met, "basin_id", "left").select("basin_id", value.alias("cohesion"))


def diagnostics(chunks: DataFrame) -> DataFrame:
    """One row: basins, nodes, median, mean and largest size, share of singletons, mean hops, whether the geometry is sound."""
    sizes = chunks.groupBy("basin_id").agg(F.count("*").alias("n"), F.sum("hops").alias("hops"))
    single = F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.count("*")
    one = sizes.agg(
        F.count("*").alias("basins"), F.sum("n").alias("nodes"), F.median("n").alias("median_size"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"),
        F.round(single, 6).alias("singletons"), F.round(F.sum("hops") / F.sum("n"), 6).alias("mean_hops"),
    )
    return one.withColumn("sound", (F.col("median_size") >= 3) & (F.col("singletons") < 0.40))


def is_flat(chunks: DataFrame) -> bool:
    """One chunk a document, and nearly as many basins: the geometry that switches the ranking."""
    r = chunks.agg(F.max("chunk_index").alias("m"), F.countDistinct("basin_id").alias("b"), F.count("*").alias("n")).first()
    return r["n"] == 0 or (r["m"] == 0 and r["b"] >= max(1, int(0.9 * r["n"])))


def virtual_edges(pairs: DataFrame, cap: int = 5, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """src, dst, sim: the greedy choice by (sim descending, src, dst) with at most ``cap`` edges a node, without a loop over edges.

    An edge that is among the best of what both its ends may still take is chosen by the greedy order too, so whole rounds
    are taken at once.  pairs: src < dst, sim, of nodes in different basins without an edge; each pass looks at a node's
    nearest so many.
    """
    pairs = table(pairs.select("src", "dst", "sim").distinct())
    chosen = pairs.limit(0)
    both = lambda x: x.select(F.col("src").alias("n"), "*").unionByName(x.select(F.col("dst").alias("n"), "*"))
    by = Window.partitionBy("n").orderBy(F.desc("sim"), "src", "dst")
    near = table(both(pairs).withColumn("near", F.row_number().over(by)).groupBy("src", "dst", "sim").agg(F.min("near").alias("near")).filter(F.col("near") <= max(passes)))
    # an edge with an end that may take no more is out for good, so each round carries on with what is left of the last
    for most in passes:
        used = both(chosen).groupBy("n").agg(F.count("*").alias("used"))
        left = _open(near.filter(F.col("near") <= most).select("src", "dst", "sim", F.lit(cap).alias("a"), F.lit(cap).alias("b")).join(chosen.select("src", "dst"), ["src", "dst"], "left_anti"), used)
        while True:
            left = table(left)
            ends = left.select(F.col("src").alias("n"), F.col("a").alias("free"), "src", "dst", "sim").unionByName(left.select(F.col("dst").alias("n"), F.col("b").alias("free"), "src", "dst", "sim"))
            placed = ends.withColumn("ok", (F.row_number().over(by) <= F.col("free")).cast("int"))
            taken = table(placed.groupBy("src", "dst", "sim").agg(F.min("ok").alias("ok")).filter("ok = 1").select("src", "dst", "sim"))
            if not taken.limit(1).count():
                break
            chosen = chosen.unionByName(taken)
            left = _open(left.join(taken.select("src", "dst"), ["src", "dst"], "left_anti"), both(taken).groupBy("n").agg(F.count("*").alias("used")))
        chosen = table(chosen)
    return chosen


def _open(edges: DataFrame, used: DataFrame) -> DataFrame:
    """src, dst, sim, a, b: the edges whose ends may still take a and b edges after those used (n, used)."""
    out = edges
    for end, free in (("src", "a"), ("dst", "b")):
        out = out.join(used.withColumnRenamed("n", end), end, "left").withColumn(free, F.col(free) - F.coalesce("used", F.lit(0))).drop("used").filter(F.col(free) > 0)
    return out.select("src", "dst", "sim", "a", "b")


def keep_summaries(new: DataFrame, old: DataFrame) -> DataFrame:
    """Summaries a model wrote outlive a rebuild where their basin does: new and old have basin_id, l3_summary, l3_source."""
    was = old.filter("l3_source = 'llm'").select("basin_id", F.col("l3_summary").alias("was"))
    out = new.join(was, "basin_id", "left")
    return out.withColumn("l3_source", F.when(F.col("was").isNotNull(), "llm").otherwise(F.col("l3_source"))).withColumn("l3_summary", F.coalesce("was", "l3_summary")).drop("was")
