"""An index that follows a stream of documents: each micro-batch becomes a generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, topology
from ..sources import snapshot


def build(docs: DataFrame) -> DataFrame:
    """doc_id, source, text -> chunks with ids, spans, sections and hops."""
    nodes = chunking.nodes(chunking.chunks(docs.withColumn("source", F.col("source").cast("string"))))
    return topology.fixed_sections(nodes)


def upsert(store: snapshot.Store, docs: DataFrame, make: Callable[[DataFrame], DataFrame] = build) -> str | None:
    """Publish a generation in which the sources of ``docs`` are replaced; None where nothing came in."""
    if not docs.limit(1).count():
        return None
    new = make(docs)
    now = store.current()
    # without an index there is nothing old, but equal chunks that came twice still become one
    old = store.load()["chunks"] if now else new.limit(0)
    new = snapshot.merge(old, docs.select(F.col("source").cast("string").alias("source")), new)
    return store.publish({"chunks": new}, {"chunk_policy": 2}, expected=now["build"] if now else None)


def follow(stream: DataFrame, store: snapshot.Store, checkpoint: str, make: Callable[[DataFrame], DataFrame] = build):
    """A started query that upserts each micro-batch; a batch that runs again replaces the same sources with the same chunks."""
    return stream.writeStream.foreachBatch(lambda df, n: upsert(store, df, make) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
