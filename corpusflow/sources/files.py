"""Files as documents: text, Markdown, PDF and source code, with encodings decided the strict way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is read and what is passed over.
TEXT_ENDINGS = ("txt", "md", "markdown")
SKIPPED_FOLDERS = (".git", "__pycache__", "node_modules", ".venv", "venv")
MERGE_PAGES_FROM = 4000

SCHEMA = "source string, page int, text string, sha256 string, status string, reason string"


def decode(data: bytes, encoding: str | None = None, detect=None) -> str:
    """Text of a file: the named encoding, else UTF-8 (with or without a mark), else what ``detect`` is sure of; else an error.

    ``detect`` takes bytes and returns (encoding, chaos, coherence in percent) or None.
    """
    if encoding:
        return data.decode(encoding)
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        guess = detect(data) if detect else _detect(data)
        if guess and guess[1] <= 20 and guess[2] >= 20:
            return data.decode(guess[0])
        raise


def _detect(data: bytes):
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(data).best()
    return best and (best.encoding, best.percent_chaos, best.percent_coherence)


def pdf_pages(data: bytes) -> list[tuple[int, str]]:
    """(page from 0, text) of the pages that have text."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e
    import io

    return [(i, t) for i, p in enumerate(PdfReader(io.BytesIO(data)).pages) if (t := p.extract_text() or "").strip()]


def merged_pages(pages: list[tuple[int, str]]) -> list[tuple[int | None, str]]:
    """Long documents lose their pages: one text, cut elsewhere by sentences."""
    whole = "\n\n".join(t for _, t in pages)
    return [(None, whole)] if len(whole) > MERGE_PAGES_FROM else list(pages)


def listing(spark: SparkSession, folder: str, endings: tuple[str, ...] = TEXT_ENDINGS, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """path, content of the files under a folder; folders that start with a dot or are named in ``skipped`` are left out."""
    glob = "*.{" + ",".join(endings) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    inner = F.substring_index("path", f"{root}/", -1)
    parts = F.slice(F.split(inner, "/"), 1, F.size(F.split(inner, "/")) - 1)
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*skipped))
    return files.filter(~hidden).select("path", "content")


def documents(spark: SparkSession, folder: str, encoding: str | None = None, detect=None) -> DataFrame:
    """One row a text file or PDF page; files that can't be read have status ``error`` and a reason instead of a text."""
    files = listing(spark, folder, (*TEXT_ENDINGS, "pdf")).withColumn("sha256", F.sha2("content", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data, digest in zip(b["path"], b["content"], b["sha256"], strict=True):
                try:
                    pages = merged_pages(pdf_pages(data)) if path.lower().endswith(".pdf") else [(None, decode(data, encoding, detect))]
                    rows += [(path, p, t, digest, "ok", None) for p, t in pages]
                except (UnicodeDecodeError, RuntimeError, LookupError) as e:
                    rows.append((path, None, None, digest, "error", str(e)[:200]))
            out = pd.DataFrame(rows, columns=["source", "page", "text", "sha256", "status", "reason"])
            yield out.astype({"page": "Int32"})

    return files.mapInPandas(run, SCHEMA)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """source, sha256 of the files that a folder holds."""
    return listing(spark, folder, (*TEXT_ENDINGS, "pdf")).select(F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"))


def is_code_test(path: Column) -> Column:
    """Test and documentation folders, and test files by their name."""
    p = F.lower(path)
    return p.rlike(r"(^|/)(tests?|testing|docs?|examples?)/") | p.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, text of the Python files of a checkout without its tests and documents."""
    files = listing(spark, folder, ("py",))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    inner = F.substring_index("path", f"{root}/", -1)
    return files.filter(~is_code_test(inner)).select(inner.alias("doc_id"), F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))
