"""A session with the engine's settings, and the package shipped to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Settings that plans rely on: UTC, adaptive plans with skewed joins split, broadcasts by size only.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.config(map=CONF | {k.replace("__", "."): v for k, v in more.items()})
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> str:
    """Send this package to the executors (as ``--py-files`` would); for clusters where it isn't installed."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusflow-"), "corpusflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("corpusflow", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    return path
