"""What the operators of this subpackage share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an Arrow batch holds at most: rows, and bytes unless one row has more.
BATCH_ROWS, BATCH_BYTES = 128, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where all of Spark runs on this machine (tests, a laptop) and none is named, a temporary folder is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    if not _made:
        atexit.register(drop_made)
    path = f"{shared_dir(spark)}/corpusflow/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def drop_made(*paths: str) -> None:
    """Remove the tables that were written (all of them without arguments)."""
    for path in paths or list(_made):
        spark = _made.pop(path, None)
        if spark is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the session may be gone by now
                pass


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, read it back, and say where it is (for ``drop_made``).

    This cuts the lineage: what follows starts from committed files, which outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """The same for a table that stays until the application ends."""
    return written(df, tag)[0]


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes: whole texts can be long.

    Spark reads these settings of the session when a plan is run, so they are left as they are where they are smaller.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(key, str(most))


def runs(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until ``column`` (a string column) holds about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            held.append(b)
            total += b.column(column).nbytes
            if total >= size:
                yield whole()
                held, total = [], 0
    if held:
        yield whole()


def narrow(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns an operator reads, each once (extra columns can't clash with its own)."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)])


def ascii_lower(column):
    """Lower-case A-Z only, as the contracts ask; letters beyond ASCII stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, upper, upper.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is: ``CORPUSFLOW_TOKENIZERS`` or the installed package."""
    top = os.environ.get("CORPUSFLOW_TOKENIZERS")
    if top:
        return os.path.join(top, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Ask for a broadcast only where a count shows that ``df`` has at most ``most_rows`` rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
