"""8. WARC files and their fixity: Merkle trees over records and ordered offset ranges.

``write_warc`` writes rows as WARC/1.1 resource records, each a gzip member of its own, several files of consecutive records;
so a record can be read at its offset, and damage within a file stays within a record.  ``index_warc`` reads files back and
gives each record's place, stored length and hash.  ``merkle`` builds one tree for a replica: its leaves are ranges of ``LEAF`` consecutive
records (hash of their offsets, lengths and record hashes), above them ``FANOUT`` children a node up to one root a file,
and above the ordered file roots, by ever shorter prefixes of the file number, up to one root for the replica.  ``audit``
compares two replicas from that root down and follows only branches that differ, so it reads record hashes only of ranges
that hold damage.

Files are written and read by Spark's own writers and readers.  Between members, and at the end, stands an empty gzip member
(``MARK``): it unpacks to nothing, is the text writer's line separator, and tells the records of a damaged file apart without
unpacking them.  Files end where their bytes reach ``FILE_BYTES``, so a run of large records makes more files, not larger
ones; a file is read as a whole by one task (a single larger record makes a file of its own size).

Defined results: a null url is written as ``urn:page:<id>``, a null or empty body as an empty block, a null id as an empty one;
a very long body is one record in a file of its own; rows that are equal make records of their own in any order (their ids
are alike, their places differ); an empty table writes no record and audits as sound; other columns, whatever their
names, are ignored.  A record that can't be unpacked is indexed by its stored bytes, without id and ``digest``; a file that
doesn't end with the mark is indexed, but not copied.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAF, FANOUT = 16, 16
#: Bytes of a file, about.
FILE_BYTES = 32 << 20
#: Bits of a file number that each level above the file roots takes off.
FILE_BITS = 16
#: Compression of a record: of zlib's levels one that costs little.
LEVEL = 3
CRLF = "\r\n"
#: An empty gzip member.
MARK = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)


def record(page_id, url, body) -> F.Column:
    """A row as a record, without the two line breaks that end it."""
    name = F.coalesce(page_id.cast("string"), F.lit(""))
    body = F.coalesce(body.cast("string"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(url.cast("string"), F.concat(F.lit("urn:page:"), name)), r"[\r\n]+", " ")
    lines = ["WARC/1.1", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), clean), "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit(CRLF * 2), body)


def pack(data: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def lay_out(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", file_bytes: int | None = None) -> DataFrame:
    """(file, n, page_id, member): each read partition's records in order, packed, and cut into files where bytes have run up.

    Nothing moves: a file's number is its partition's and its place there.
    """
    p = lambda c: F.col(f"`{c}`")
    rows = pages.select(p(page_id).alias("page_id"), record(p(page_id), p(url), p(body)).alias("record"))
    common.small_batches(pages.sparkSession)
    most = file_bytes or FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, n, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            files, places, members = [], [], []
            for x in b.column(1).cast(pa.binary()).to_pylist():
                m = pack(x + b"\r\n\r\n")
                if held and held + len(m) > most:
                    file, n, held = file + 1, 0, 0
                files.append(file)
                places.append(n)
                members.append(m)
                n, held = n + 1, held + len(m) + len(MARK)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(places, pa.int64()), b.column(0), pa.array(members, pa.binary())], names=["file", "n", "page_id", "member"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"file long, n long, page_id {kind}, member binary")


def _write(files: DataFrame, out: str) -> None:
    # the separator's bytes are given by an encoding that has a character for each byte
    text = files.select("file", F.col("value").cast("string").alias("value"))
    text.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", MARK.decode("latin-1")).option("compression", "none").text(out)


def write_warc(laid: DataFrame, out: str) -> None:
    """Write one replica: a folder ``file=<k>`` with one WARC file for each file of the layout; no file spans two tasks."""
    _write(laid.select("file", "n", F.col("member").alias("value")).sortWithinPartitions("file", "n").select("file", "value"), out)


def _files(spark: SparkSession, out: str) -> DataFrame:
    from_path = F.regexp_extract(F.col("path"), r"/file=([0-9]+)/", 1).cast("long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select(from_path.alias("file"), "content")


def unpacked(member: bytes, most: int = 0) -> bytes | None:
    """What one member holds (its first ``most`` bytes, if given); none if it can't be unpacked whole."""
    try:
        z = zlib.decompressobj(31)
        out = z.decompress(member, most)
        return out if most or z.eof and not z.unused_data else None
    except zlib.error:
        return None


def record_id(data: bytes | None) -> str:
    """The id that a record's header names; empty where there is none."""
    at = data.find(b"\r\nWARC-Record-ID: ") if data and data.startswith(b"WARC/1.") else -1
    end = data.find(b"\r\n", at + 2) if at >= 0 else -1
    return data[at + 18 : end].decode("utf-8", "replace") if end >= 0 else ""


def parse(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and stored bytes of each record of a file."""
    at = 0
    while at < len(data):
        end = data.find(MARK, at)
        end = len(data) if end < 0 else end
        yield at, data[at:end]
        at = end + len(MARK)


def copy_warc(spark: SparkSession, source: str, out: str, change: Callable[[str, bytes], bytes] | None = None) -> None:
    """Write a replica by copying the files of another; ``change`` (record id, stored bytes -> stored bytes) stands for damage on the way."""
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = data.as_py()
                if not whole.endswith(MARK):
                    raise ValueError(f"file {f} is cut short and can't be copied")
                value = whole[: -len(MARK)]  # the writer puts the last mark
                if change is not None:
                    value = MARK.join([change(record_id(unpacked(m, 512)), m) for _, m in parse(whole)])
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([value], pa.binary())], names=["file", "value"])

    _write(_files(spark, source).mapInArrow(run, "file long, value binary"), out)


def index_warc(spark: SparkSession, out: str) -> DataFrame:
    """Every record of a replica: file, n, offset, length and sha256 (as stored), record_id, size and digest (unpacked)."""
    files = _files(spark, out)
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["file", "n", "offset", "length", "sha256", "record_id", "size", "digest"]
        for b in batches:
            for f, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = []
                for n, (at, m) in enumerate(parse(data.as_py())):
                    x = unpacked(m)
                    got.append((f, n, at, len(m), hashlib.sha256(m).hexdigest(), record_id(x), None if x is None else len(x), None if x is None else hashlib.sha256(x).hexdigest()))
                columns = list(zip(*got, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(run, "file long, n long, offset long, length long, sha256 string, record_id string, size long, digest string")


def _over(level: DataFrame, up: list, k: int, node) -> DataFrame:
    """The nodes above those of ``level``: children in order, hashed together."""
    by = level.groupBy(*up, node.cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "hash"))).alias("c"))
    return by.select(*(up or [F.lit(-1).cast("long").alias("file")]), F.lit(k).alias("level"), F.col("up").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ","), 256).alias("hash"))


def depth(*indexes: DataFrame) -> tuple[int, int]:
    """Levels within files and levels above them that hold every given replica in one tree."""
    n = file = 0
    for index in indexes:
        top = index.agg(F.max("n"), F.max("file")).first()
        n, file = max(n, top[0] or 0), max(file, top[1] or 0)
    inner, nodes = 0, n // LEAF + 1
    while nodes > 1:  # the depth grows with the logarithm of a file's records
        inner, nodes = inner + 1, -(-nodes // FANOUT)
    return inner, max(1, -(-file.bit_length() // FILE_BITS))


def merkle(index: DataFrame, levels: tuple[int, int] | None = None) -> DataFrame:
    """(file, level, node, hash): level 0 holds ranges of LEAF records, a file's last level its root.

    Levels above have the file -1 and the file number without its last bits as the node; the last one is the replica's root.
    """
    inner, outer = levels or depth(index)
    one = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha256")
    leaf = index.groupBy("file", F.floor(F.col("n") / LEAF).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("n", one.alias("h")))).alias("c"))
    level = leaf.select("file", F.lit(0).alias("level"), "node", F.sha2(F.array_join(F.transform("c", lambda x: x["h"]), ","), 256).alias("hash"))
    out = level
    for k in range(1, inner + 1):
        level = _over(level, [F.col("file")], k, F.floor(F.col("node") / FANOUT))
        out = out.union(level)
    level = level.select(F.col("file").alias("node"), "hash")
    for k in range(inner + 1, inner + outer + 1):
        above = _over(level, [], k, F.shiftright("node", FILE_BITS))
        out, level = out.union(above), above.select("node", "hash")
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records that differ between two replicas' indexes: file, n, record_id, offset, length, sha256, other_sha256.

    The two roots are compared first; a level is joined only below nodes that differ.
    """
    inner, outer = levels = depth(ours, theirs)
    a, b = common.materialize(merkle(ours, levels), "merkle"), common.materialize(merkle(theirs, levels), "merkle")
    other = b.select("file", "level", "node", F.col("hash").alias("other"))
    keys = ["file", "level", "node"]
    at = lambda x, k: x.filter(F.col("level") == k)
    differ = lambda x, y: x.join(y, keys, "full_outer").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")
    bad = differ(at(a, inner + outer), at(other, inner + outer))
    for k in range(inner + outer - 1, -1, -1):
        bad = common.materialize(bad, "branches")
        if not bad.limit(1).count():
            break
        if k > inner:  # prefixes of file numbers
            up, name = F.shiftright("node", FILE_BITS), bad.select(F.col("node").alias("__up"))
        elif k == inner:  # file roots
            up, name = F.shiftright("file", FILE_BITS), bad.select(F.col("node").alias("__up"))
        else:
            up, name = F.floor(F.col("node") / FANOUT), bad.select("file", F.col("node").alias("__up"))
        below = lambda x, k=k, up=up, name=name: at(x, k).withColumn("__up", up).join(name, name.columns, "left_semi").drop("__up")
        bad = differ(below(a), below(other))
    else:
        bad = common.materialize(bad, "branches")
    within = lambda x: x.withColumn("node", F.floor(F.col("n") / LEAF)).join(bad, ["file", "node"], "left_semi").drop("node")
    y = within(theirs).select("file", "n", F.col("sha256").alias("other_sha256"), F.col("offset").alias("other_offset"))
    both = within(ours).join(y, ["file", "n"], "full_outer")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("other_sha256")) | ~F.col("offset").eqNullSafe(F.col("other_offset"))).select("file", "n", "record_id", "offset", "length", "sha256", "other_sha256")


def flip(member: bytes) -> bytes:
    """One byte in the middle changed, as damage on a disk does."""
    at = len(member) // 2
    return member[:at] + bytes([member[at] ^ 0x55]) + member[at + 1 :]


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files and a copy of these with one stored byte changed in every hundredth page; the audit finds them."""
    sound, hurt = common.new_path(spark, "warc"), common.new_path(spark, "warc")
    write_warc(lay_out(common.table(spark, sf_dir, "pages")), sound)

    def damage(name: str, member: bytes) -> bytes:
        page = name.removeprefix("<urn:page:").removesuffix(">")
        return flip(member) if page and int(page) % 100 == 0 else member

    copy_warc(spark, sound, hurt, damage)
    ours, theirs = common.materialize(index_warc(spark, sound), "index"), common.materialize(index_warc(spark, hurt), "index")
    found = audit(ours, theirs).select("file", "n", F.lit(True).alias("damaged"))
    page = F.regexp_extract("record_id", r"^<urn:page:(-?[0-9]*)>$", 1)
    return ours.join(found, ["file", "n"], "left").select(F.when(page != "", page).cast("long").alias("page_id"), F.col("size").alias("length"), F.col("digest").alias("sha256"), F.coalesce("damaged", F.lit(False)).alias("damaged"))


ORACLE_SQL = {
    "op8_warc": r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, 'urn:page:' || page_id), '[\r\n]+', ' ', 'g') || chr(13) || chr(10)
  || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
  || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages)
SELECT page_id, strlen(rec)::BIGINT AS length, sha256(rec) AS sha256, page_id % 100 = 0 AS damaged FROM r"""
}

QUERIES = {"op8_warc": op8_warc}
