"""Tables between steps, and broadcasts behind a count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the folder that the session shares with its executors, so a lost one costs only its part.

    ``spark.checkpoint.dir`` names that folder; without one (a laptop, a test) the rows are kept where they are.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        return df.persist()
    path = f"{top.rstrip('/')}/corpusflow/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast behind a count; beyond it the planner's own join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
