import hashlib

from pyspark.sql import functions as F

from corpusflow.llm import common
from corpusflow.llm import warc as W


def replicas(spark, tmp_path, rows, hurt=(), change=W.flip, **how):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, record string, n int").repartition(3)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    W.write_warc(W.lay_out(df, **how), a)
    names = {f"<urn:page:{i}>" for i in hurt}
    W.copy_warc(spark, a, b, lambda name, m: change(m) if name in names else m)
    return W.index_warc(spark, a), W.index_warc(spark, b)


def expected(i, url, html):
    name = "" if i is None else str(i)
    body = (html or "").encode()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {url or 'urn:page:' + name}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_files_and_audit(spark, tmp_path):
    import glob
    import gzip

    rows = [(i, f"http://x/{i}", "é body\r\n\r\nWARC/ looks" * (i % 7)) for i in range(700)] + [(None, None, None), (5, "u", ""), (5, "u", ""), (1000, "u", "".join(map(str, range(60_000))))]
    hurt = [3, 250, 699]
    a, b = replicas(spark, tmp_path, rows, hurt, file_bytes=20_000)
    got = a.collect()
    assert sorted(r.digest for r in got) == sorted(hashlib.sha256(expected(*r)).hexdigest() for r in rows)
    sizes = [r.length for r in got]
    by = {}
    for r in got:
        by[r.file] = by.get(r.file, 0) + r.length
    assert len(by) > 3 and all(n <= 20_000 or n == max(sizes) for n in by.values())  # a file is cut by its bytes
    found = W.audit(common.materialize(a, "t"), common.materialize(b, "t")).collect()
    assert sorted(r.record_id for r in found) == sorted(f"<urn:page:{i}>" for i in hurt)
    assert W.audit(a, a).count() == 0
    for f in by:  # the whole file is a gzip file, and a record can be read at its offset
        (path,) = glob.glob(str(tmp_path / "a" / f"file={f}" / "*.txt"))
        data = open(path, "rb").read()
        mine = sorted((r.n, r.offset, r.length, r.digest) for r in got if r.file == f)
        assert [hashlib.sha256(gzip.decompress(data[o : o + k])).hexdigest() for _, o, k, _ in mine] == [d for *_, d in mine]
        assert b"".join(gzip.decompress(data[o : o + k]) for _, o, k, _ in mine) == gzip.decompress(data)


def test_damage_is_located(spark, tmp_path):
    """Any one byte of a file: the record that holds it is named, the others stay sound."""
    import glob

    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i * 7919}</p>" * 9) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    W.write_warc(W.lay_out(df), a)
    W.copy_warc(spark, a, b)
    (path,) = glob.glob(b + "/file=0/*.txt")
    data = open(path, "rb").read()
    index = common.materialize(W.index_warc(spark, a), "t")
    places = {r.n: (r.offset, r.length) for r in index.collect()}
    for at in (0, places[7][0] + 30, places[20][0] + places[20][1] - 1, places[41][0] + 4):
        import os

        os.remove(glob.glob(b + "/file=0/.*.crc")[0]) if glob.glob(b + "/file=0/.*.crc") else None
        open(path, "wb").write(data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :])
        (n,) = [k for k, (o, size) in places.items() if o <= at < o + size]
        assert [r.n for r in W.audit(index, W.index_warc(spark, b)).collect()] == [n]


def test_trees_have_one_root(spark):
    n = W.LEAF * W.FANOUT + 5
    files = [0, 3, 1 << 32, (1 << 32) + 70_000]
    index = spark.range(n).select(F.explode(F.array(*[F.lit(f).cast("long") for f in files])).alias("file"), F.col("id").alias("n"), (F.col("id") * 10).alias("offset"), F.lit(10).alias("length"), F.lit("r").alias("record_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    levels = {}
    for r in W.merkle(index).collect():
        levels.setdefault(r.level, []).append((r.file, r.node))
    assert {k: len(v) for k, v in levels.items()} == {0: 4 * (W.FANOUT + 1), 1: 8, 2: 4, 3: 3, 4: 2, 5: 1} and levels[5] == [(-1, 0)]
    cut = index.filter(f"n < {n - 1} or file <> 3")
    assert [(r.file, r.n) for r in W.audit(index, cut).collect()] == [(3, n - 1)]
    assert {r.file for r in W.audit(index, index.filter("file <> 4294967296")).collect()} == {1 << 32}


def test_no_pages(spark, tmp_path):
    a, b = replicas(spark, tmp_path, [])
    assert a.count() == 0 and W.audit(a, b).count() == 0


def test_cut_files(spark, tmp_path):
    import pytest

    members = [W.pack(expected(i, "u", "abc")) for i in (1, 2, 3)]
    data = W.MARK.join([*members, b""])
    assert [x for _, x in W.parse(data)] == members and [W.record_id(W.unpacked(x)) for _, x in W.parse(data)] == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    cut = data[: -len(W.MARK) - 9]
    assert [W.unpacked(x) is not None for _, x in W.parse(cut)] == [True, True, False] and W.unpacked(b"") is None
    (tmp_path / "c" / "file=0").mkdir(parents=True)
    (tmp_path / "c" / "file=0" / "x.txt").write_bytes(cut)
    got = {r.n: r for r in W.index_warc(spark, str(tmp_path / "c")).collect()}
    assert len(got) == 3 and got[2].digest is None and got[2].record_id == ""
    with pytest.raises(Exception, match="cut short"):
        W.copy_warc(spark, str(tmp_path / "c"), str(tmp_path / "d"))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = W.op8_warc(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        want = expected(r.page_id, rows[r.page_id].url, rows[r.page_id].html)
        assert (r.length, r.sha256, r.damaged) == (len(want), hashlib.sha256(want).hexdigest(), r.page_id % 100 == 0)
