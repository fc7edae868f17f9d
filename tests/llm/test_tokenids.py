import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusflow.llm import tokenids as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
OWN = K.PieceEncoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=300))
def test_elias_fano(values):
    values.sort()
    e = K.EliasFano.build(values)
    back, n = K.EliasFano.unpack(memoryview(e.pack()))
    assert n == len(e.pack())
    assert back.take(range(len(values))).tolist() == back.all().tolist() == values and [back[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert K.EliasFano.build(values).nbytes() * 8 < 14 * len(values)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab XY 01's.,!\n\t\r<|>éß_-  "), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60))
def test_pieces_encode_as_the_library(text):
    assert np.frombuffer(OWN.encode(text), OWN.form).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_texts_of_note():
    for t in ["a <|endoftext|> b", "x \n y", "x\n  y ", " lead", "trail ", "a\n\n b", "it's 've x  y", "w" * 5000]:
        assert np.frombuffer(OWN.encode(t), OWN.form).tolist() == LIB.encode(t, add_special_tokens=False).ids


def test_runs_and_memory(monkeypatch):
    """Many texts at once, slices, and a memory so small that it turns over all the time."""
    monkeypatch.setattr(K, "MEMO", 20)
    own = K.PieceEncoder(PATH)
    rng = np.random.default_rng(2)
    parts = ["word", "Über", "été,", "x1", "it's", "\n", "  ", "end.", "!!", "a.b", "\t", "<|endoftext|>", "нет", "語", "\u00a0", "\0", "é.\nIs", "--", "''"]
    texts = [rng.choice([" ", "", "\n"]).join(rng.choice(parts, rng.integers(0, 40))) for _ in range(400)] + ["no " * 100_000]
    want = [np.asarray(e.ids, own.form).tobytes() for e in LIB.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.run(pa.array(texts)) == want
    assert own.run(pa.array(texts).slice(7, 200)) == want[7:207] and own.run(pa.array([None, ""], pa.string())) == [b"", b""]


def expected(rows):
    start, out = 0, []
    for d, t in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_IDS", 50)
    rows = [(5, "five words are in here", "x"), (None, "nobody", "x"), (-3, None, "x"), (7, "", "x"), (9, "long " * 300, "x"), (5, "five words are in here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = str(tmp_path / "t")
    K.write_token_files(df, out, parts=3)
    got = K.read_token_files(spark, out).collect()
    want = expected(sorted(((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got) == sorted((s, d, n, c) for d, s, n, c in want)
    import glob

    block = K.Block(open(sorted(glob.glob(out + "/*.txt"))[0], "rb").read())
    assert block.ids(0).tolist()[-1] == 2 and block.doc_id(0) is None


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    K.write_token_files(df, str(tmp_path / "t"))
    assert K.read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert sorted(map(tuple, K.op10_token_ids(spark, d).collect())) == expected(rows)
