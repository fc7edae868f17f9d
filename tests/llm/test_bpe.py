import hashlib
import struct

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = bpe.WordBpe(PATH)


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    _, ids = OWN.packed(pa.array([text]))
    got, decoded = ids[0].as_py(), OWN.decoded(ids)[0].as_py()
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want == OWN.encode(text)
    assert decoded == LIB.decode(want, skip_special_tokens=False) == OWN.decode(want)


def test_texts_of_note():
    for t in ["", " ", "a", "Hello  WORLD's\n\tx1234", "Hello<|endoftext|>x <|startoftext|> <|end", "ΑΣ ΣΑΣ İx", "é e ́", "日本語 한국어 🎉🎉", "x" * 3000, "\x1c\x1d a b c​d"]:
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ 0129's.,!\n\t<|>éÉßΣ_-"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn", "Lo", "Lm"])), max_size=60))
def test_random_texts(text):
    same(text)


def test_code_points():
    """Between letters and after a digit: the classes and the letter case are the library's.  Large uniform blocks by samples."""
    wide = [*range(0x20000, 0x110000, 61), *range(0x3400, 0xD800, 13), *range(0xE000, 0xF900, 13), *range(0x17000, 0x18CD0, 13)]
    points = [c for c in (*range(0x3400), *range(0xF900, 0x17000), *range(0x18CD0, 0x20000), *wide)]
    texts = [f"x{chr(c)}y 1{chr(c)}" for c in points]
    want = [e.ids for e in LIB.encode_batch_fast(texts, add_special_tokens=False)]
    n, got = OWN.packed(pa.array(texts))
    assert n.to_pylist() == [len(w) for w in want]
    for t, w, g in zip(texts, want, got.to_pylist(), strict=True):
        assert g == struct.pack(f"<{len(w)}I", *w), ascii(t)


def test_long_texts_and_runs(spark):
    """Very long texts and many runs: each text whole."""
    texts = ["wörd " * 400_000, "x" * 5_000, None, *[f"line {i}\n" * 50 for i in range(600)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.bpe_encode(df).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("h")).collect()}
    part = pa.array([t or "" for t in texts]).slice(3, 200)
    assert OWN.packed(part)[0].to_pylist() == [len(LIB.encode(t.as_py(), add_special_tokens=False).ids) for t in part]
    for i, t in enumerate(texts):
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].h) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_operator(spark):
    rows = [(1, "Some TEXT here.", "k"), (2, None, "k"), (3, "", None), (3, "Some TEXT here.", "z"), (None, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.bpe_encode(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    got = out.collect()
    assert len(got) == 5
    for r in got:
        want = LIB.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and bytes(r.ids) == struct.pack(f"<{len(want)}I", *want)
    assert {r.decoded for r in bpe.bpe_decode(out.drop("decoded")).collect()} == {r.decoded for r in got}
    assert bpe.bpe_encode(df.filter("false")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = bpe.op1_bpe(spark, d).collect()
    assert len(got) == len(text)
    for r in got:
        ids = LIB.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
