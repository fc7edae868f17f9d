from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.operators import chunking as C


def test_token_windows():
    assert C.split_tokens("abcdefgh", 4, 1, count=len) == ["abcd", "defg", "gh"]
    assert C.split_tokens("abcdefgh", 4, 1, offsets=lambda t: [(i, i + 1) for i in range(len(t))]) == ["abcd", "defg", "gh"]
    assert C.split_tokens("abcdefgh", 99, 1, count=len, limit=3) == ["abc", "cde", "efg", "gh"]
    assert C.split_tokens("", 4, 1) == []


def test_sentence_leaves():
    got = C.split_sentences("One is here. Two is there. Three goes on. Four ends it.", size=40, overlap=0)
    assert got == ["One is here. Two is there.", "Three goes on. Four ends it."]
    carried = C.split_sentences("Aa bb. Cc dd. Ee ff. Gg hh.", size=40, overlap=8)
    assert carried == ["Aa bb. Cc dd.", "Cc dd. Ee ff.", "Ee ff. Gg hh."]
    assert C.split_sentences("same. same. same.", size=40, overlap=0, most=1) == ["same."]
    assert C.split_sentences("   ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n?;é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitters_lose_nothing(text, size, overlap):
    for made in (C.split_chars(text, size, overlap), C.split_sentences(text, size, overlap)):
        assert all(len(c) <= size for c in made)
        for word in text.split():
            if len(word) <= size // 2 and not set(word) & set(".?;"):
                assert any(word in c for c in made), (word, made)


def test_policy_and_nodes(spark):
    docs = spark.createDataFrame([(1, "s", "Short one."), (2, "s", "A sentence that is long enough. " * 200), (3, "t", ""), (4, "t", None)], "doc_id long, source string, text string")
    rows = C.nodes(C.chunks(docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2} and {r.policy for r in by[2]} == {"sentence_window"} and by[1][0].parent_span is None
    spans = {r.chunk_index: list(r.parent_span) for r in by[2]}
    n = by[2][0].n_chunks
    assert len(by[2]) == n and spans[0] == [0, min(3, n - 1)] and spans[n - 1] == [max(0, n - 4), n - 1]
    assert all(len(r.id) == 24 for r in rows)


def test_budget(spark):
    rows = [("q", 1, "a b c"), ("q", 2, None), ("q", 3, "d e"), ("q", 4, "f g h i"), ("q", 5, "j"), ("r", 1, "x " * 50)]
    df = spark.createDataFrame(rows, "qid string, rank int, text string")
    assert sorted((r.qid, r["rank"]) for r in C.budget_pack(df, 6).collect()) == [("q", 1), ("q", 3), ("r", 1)]


def test_excerpts(spark):
    df = spark.createDataFrame([("",), ("short",), ("word " * 2000,)], "t string").select(C.mid_excerpts(F.col("t")).alias("x"))
    assert [len(r.x) for r in df.collect()] == [0, 1, 3]
