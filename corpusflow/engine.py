"""The engine: an index under a folder, made and kept up from documents, and searched by batches of queries.

``ingest`` adds sources, ``sync`` makes the index follow a folder or table (new, changed and deleted sources), ``reindex``
builds one from nothing.  Each publishes a whole generation (``sources.snapshot``) or leaves the old one.  ``query`` and ``brief``
take a batch of queries and return DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import briefing, chunking, dense, summaries, topology, walk
from .operators.tables import table
from .plans import search
from .sources import files, snapshot

RANKINGS, ROUTES = ("auto", "flat", "long"), ("auto", "local", "global", "hybrid")


@dataclass(frozen=True)
class Config:
    """root: the index's folder.  Everything else has a default; values that can't work are refused."""

    root: str
    ranking: str = "auto"
    route: str = "auto"
    chunk_size: int = chunking.SHORT
    chunk_overlap: int = chunking.SHORT_OVERLAP
    encoding: str | None = None
    least_confidence: float = briefing.LEAST_CONFIDENCE
    context_tokens: int = 2000
    encoder_name: str = "hashed"
    stemmer_name: str | None = None
    #: Measures a chunk in tokens instead of characters, if given (see ``chunking.split_tokens``).
    count_tokens: Callable[[str], int] | None = None
    scorer: Callable[[list[str], list[str]], list[float]] | None = None
    search: search.Options = field(default_factory=search.Options)

    def __post_init__(self):
        if not self.root:
            raise ValueError("root must name a folder")
        if self.ranking not in RANKINGS or self.route not in ROUTES:
            raise ValueError(f"ranking is one of {RANKINGS}, route one of {ROUTES}")
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("a chunk needs a size, and an overlap below it")
        if not 0 <= self.least_confidence <= 1 or self.context_tokens < 1:
            raise ValueError("least_confidence lies in 0 to 1, context_tokens is positive")
        if (self.search.encoder is None) != (self.encoder_name == "hashed"):
            raise ValueError("an encoder and its name go together")
        if (self.search.stem is None) != (self.stemmer_name is None):
            raise ValueError("a stemmer and its name go together")

    def manifest(self) -> dict:
        """What an index must have been made with to be read by this configuration."""
        return {"encoder": self.encoder_name, "stemming": self.stemmer_name, "chunk_policy": 2}


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = snapshot.Store(spark, config.root)

    @classmethod
    def create(cls, spark: SparkSession, config: Config) -> Engine:
        """An engine for a new index; a folder that has one is refused."""
        engine = cls(spark, config)
        if engine.store.current():
            raise snapshot.Conflict(f"there is an index under {config.root}")
        return engine

    @classmethod
    def load(cls, spark: SparkSession, config: Config) -> Engine:
        """An engine for an index that exists, was made with a matching configuration, and is sound."""
        engine = cls(spark, config)
        engine.tables()
        return engine

    def tables(self) -> dict[str, DataFrame]:
        return self.store.load(self.config.manifest())

    # making and keeping up

    def _read(self, source: str | DataFrame) -> DataFrame:
        """doc_id, source, text, sha256, status of a folder's files, or of a table (doc_id, text, and source if it has one).

        A folder whose files change while they are read is refused; what was read is a table, so it stays as it was.
        """
        if not isinstance(source, str):
            named = source if "source" in source.columns else source.withColumn("source", F.col("doc_id").cast("string"))
            status = F.col("status") if "status" in named.columns else F.lit("ok")
            rows = named.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", status.alias("status"))
            # a source's hash covers all its documents, in any order
            each = F.concat_ws("\u001f", F.coalesce("doc_id", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256))
            hashes = rows.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), ","), 256).alias("sha256"))
            return table(rows.join(hashes, "source"))
        before = table(files.manifest(self.spark, source))
        page = F.when(F.col("page").isNotNull(), F.concat(F.lit("#"), F.col("page").cast("string"))).otherwise("")
        docs = files.documents(self.spark, source, self.config.encoding)
        docs = table(docs.select(F.concat("source", page).alias("doc_id"), "source", "text", "sha256", "status"))
        if not snapshot.same_manifest(before, files.manifest(self.spark, source)):
            raise snapshot.Conflict(f"{source} changed while it was read")
        return docs

    def _chunks(self, docs: DataFrame) -> DataFrame:
        c = self.config
        split = None
        if c.count_tokens is not None:
            count, size, overlap = c.count_tokens, c.chunk_size, c.chunk_overlap
            split = lambda text: chunking.split_tokens(text, size, overlap, count)
        pieces = chunking.chunks(docs.select("doc_id", "source", "text"), size=c.chunk_size, overlap=c.chunk_overlap, split=split)
        return topology.fixed_sections(chunking.nodes(pieces))

    def _sources(self, docs: DataFrame) -> DataFrame:
        return docs.groupBy("source").agg(F.max("sha256").alias("sha256"), F.when(F.max(F.when(F.col("status") == "ok", 0).otherwise(1)) == 1, "error").otherwise("ok").alias("status"))

    def _apply(self, source: str | DataFrame, sync: bool, whole: bool = False) -> dict[str, int]:
        docs = self._read(source)
        now = self.store.current()
        old = self.tables() if now else None
        listed = self._sources(docs)
        if whole and listed.filter("status <> 'ok'").limit(1).count():
            raise ValueError("a source could not be read: nothing is built")
        known = old["sources"] if old else listed.select("source", "sha256").limit(0)
        states = table(snapshot.classify(known, listed))
        if not sync:
            states = table(states.filter("state <> 'deleted'"))
            snapshot.refuse_changed(states)
        said = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # five at most
        if not set(said) & {"new", "changed", "deleted"}:
            return said
        fresh = docs.join(states.filter("state in ('new', 'changed')").select("source"), "source", "left_semi")
        chunks = table(self._chunks(fresh))
        replaced = states.filter("state in ('changed', 'deleted')").select("source")
        merged = snapshot.merge(old["chunks"] if old else chunks.limit(0), replaced, chunks)
        kept = states.filter("state <> 'deleted' and sha256 is not null").select("source", "sha256")
        if not sync and old:
            kept = kept.unionByName(known.select("source", "sha256").join(kept, "source", "left_anti"))
        self.store.publish({"chunks": merged, "sources": kept, "edges": topology.sequence_edges(merged)}, self.config.manifest(), expected=now["build"] if now else None)
        return said

    def ingest(self, source: str | DataFrame) -> dict[str, int]:
        """Add sources; one that is indexed with other contents is refused.  Returns the number of sources by state."""
        return self._apply(source, sync=False)

    def sync(self, source: str | DataFrame) -> dict[str, int]:
        """Make the index hold what ``source`` holds: failed sources keep what they had and are tried again next time."""
        return self._apply(source, sync=True)

    def reindex(self, source: str | DataFrame) -> dict[str, int]:
        """Build an index where there is none; any source that can't be read stops it."""
        if self.store.current():
            raise snapshot.Conflict(f"there is an index under {self.config.root}: reindex into another folder")
        return self._apply(source, sync=True, whole=True)

    def summarize(self, states: DataFrame, model: summaries.ModelCall, now: float) -> DataFrame:
        """New summary states (basin_id, fingerprint, summary, status, attempts, retry_after) of basins that are due."""
        evidence = briefing.evidence_rows(self.tables()["chunks"])
        marks = summaries.fingerprints(evidence).select("basin_id", "fingerprint")
        return summaries.summarize(snapshot.pending_summaries(marks, states, now, summaries.ATTEMPTS), evidence, model, now)

    # searching

    def _batch(self, queries: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries.select("qid", "text")
        texts = [queries] if isinstance(queries, str) else queries
        return self.spark.createDataFrame(list(enumerate(texts)), "qid long, text string")

    def _hits(self, t: dict[str, DataFrame], queries: DataFrame, k: int) -> search.Arms:
        c = self.config
        long = c.ranking == "long" or c.ranking == "auto" and not topology.is_flat(t["chunks"])
        return search.hybrid(t["chunks"], queries, replace(c.search, k=k), long, t["edges"])

    def query(self, queries: str | list[str] | DataFrame, k: int = 10) -> DataFrame:
        """qid, rank, id, doc_id, source, text: the best ``k`` chunks of each query (qid, text), reranked where there is a scorer."""
        t, q = self.tables(), self._batch(queries)
        hits = self._hits(t, q, k if self.config.scorer is None else max(25, k)).hybrid
        if self.config.scorer is not None:
            named = hits.join(q.select("qid", F.col("text").alias("query")), "qid")
            hits = briefing.rerank(named.select("qid", "id", "rank", "query"), t["chunks"], self.config.scorer, k)
        return hits.select("qid", "id", "rank").join(t["chunks"].select("id", "doc_id", "source", "text"), "id").select("qid", "rank", "id", "doc_id", "source", "text")

    def brief(self, queries: str | list[str] | DataFrame, k: int = 5, route: str | None = None) -> DataFrame:
        """qid, route, hubs, neighbors, satellites, ids, confidence, context, abstains: what an answer is written from.

        The hybrid search alone chooses the hubs.  A local query adds context by walks from its nearest chunks, a global one the
        members and labels of the basins nearest to it; basin mates follow.  Confidence is the hubs' best cosine.
        """
        how = route or self.config.route
        if how not in ROUTES or not 1 <= k <= 50:
            raise ValueError(f"route is one of {ROUTES}, k lies in 1 to 50")
        t, q = self.tables(), self._batch(queries)
        chunks = t["chunks"]
        arms = self._hits(t, q, max(2 * k, 20))
        seeds = table(arms.hybrid.select("qid", "id", "rank"))
        routed = table(q.select("qid", "text", (briefing.route(F.col("text")) if how == "auto" else F.lit(how)).alias("route")))
        dv, qv = search._vectors(arms.index, chunks.select("id", "text"), q, self.config.search)
        dv = table(dv)
        of = lambda kind, df: df.join(routed.filter(F.col("route") == kind).select("qid"), "qid", "left_semi")
        local = walk.local_search(of("local", arms.dense), chunks, t["edges"], k).select("qid", "id", F.col("rank").alias("place"))
        members = chunks.select("id", "basin_id", "hops").join(dv, "id").withColumn("summary", F.lit(None).cast("array<double>"))
        found = table(dense.basin_search(members, of("global", qv), k))
        place = (F.col("basin_rank") * 1000 + F.col("rank")).cast("int").alias("place")
        context = local.withColumn("place", F.col("place").cast("int")).unionByName(found.select("qid", "id", place))
        packet = table(briefing.packets(seeds, chunks, k, context, briefing.basin_labels(chunks)))
        hubs = packet.select("qid", F.explode(F.slice("ids", 1, F.size("hubs"))).alias("id"))
        sure = briefing.confidence(hubs, dv.select(F.col("id").cast("string").alias("id"), "vector"), qv)
        out = packet.join(briefing.contexts(packet, self.config.context_tokens), "qid").join(sure, "qid", "left").join(routed.select("qid", "route"), "qid")
        out = out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        return out.withColumn("abstains", briefing.abstains(F.col("context"), F.col("confidence"), self.config.least_confidence))
