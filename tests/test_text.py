import pytest
from pyspark.sql import functions as F

from corpusflow.functions import lexicon
from corpusflow.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, X.tokens(F.col("t")), t="IL-6 SARS-COV-2 α蛋白 東京")
    assert got == ["il-6", "il", "6", "sars-cov-2", "sars", "cov", "2", "蛋", "白", "東", "京"]
    assert one(spark, X.tokens(F.col("t").cast("string")), t=None) == []


@pytest.mark.parametrize(
    ("text", "lang"),
    [("the cat is on the mat", "en"), ("o livro não é para mim", "pt"), ("это книга", "ru"), ("한국어 문장", "ko"), ("これは本です", "ja"), ("中文句子", "zh"), ("¿qué tal?", "es"), ("für die Straße", "de"), ("un œuf", "fr"), ("il gatto non sono gli animali della casa", "it"), ("xyz", None)],
)
def test_language(spark, text, lang):
    row = spark.createDataFrame([(text,)], "t string").select(X.language(F.col("t"), X.tokens(F.col("t"))).alias("x"))
    assert row.first()["x"] == lang


def test_stopwords_follow_the_language(spark):
    df = spark.createDataFrame([(["the", "die", "cat"], "en"), (["the", "die", "cat"], "de"), (["the", "die"], None)], "t array<string>, l string")
    assert [r.x for r in df.select(X.without_stopwords(F.col("t"), F.col("l")).alias("x")).collect()] == [["die", "cat"], ["the", "cat"], ["the", "die"]]
    assert len(lexicon.STOPWORDS) == 10 and len(set(lexicon.KEYWORD_STOPWORDS)) == len(lexicon.KEYWORD_STOPWORDS)


def test_estimates(spark):
    assert one(spark, X.briefing_tokens(F.col("t")), t="漢字かな") == 4
    assert one(spark, X.briefing_tokens(F.col("t")), t="abc") == 2
    assert one(spark, X.prompt_tokens(F.col("t")), t="") == 0


@pytest.mark.parametrize(("k", "long", "want"), [(5, False, 50), (10, False, 50), (20, False, 100), (10, True, 200), (50, True, 500)])
def test_pool(spark, k, long, want):
    assert one(spark, X.candidate_pool(F.col("k"), F.col("l")), k=k, l=long) == want
    assert one(spark, X.candidate_pool(F.col("k"), F.col("l"), F.lit(30)), k=k, l=long) == 30


def test_scores_and_patches(spark):
    assert [one(spark, X.judged_score(F.col("t")), t=t) for t in ("SCORE: 9", "Score: 10/10", "none", "score 99", '{"score": 3}')] == [9, 10, 5, 10, 3]
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n--- a/y/z.py\n--- /dev/null\n--- a/x.py\n"
    assert one(spark, X.patch_files(F.col("t")), t=patch) == ["x.py", "y/z.py"]
    assert one(spark, X.model_patch(F.col("t")), t="Here:\n```diff\ndiff --git a/x b/x\n--- a/x\n```\nbye").startswith("diff --git a/x")
    assert one(spark, X.model_patch(F.col("t")), t="no patch") == ""
    assert one(spark, X.is_test_path(F.col("t")), t="src/tests/a.py") is True
    assert one(spark, X.is_test_path(F.col("t")), t="src/contest.py") is False
    assert one(spark, X.repo_path(F.col("t")), t=".\\a\\b.py") == "a/b.py"


def test_first_sentence(spark):
    assert one(spark, X.first_sentence(F.col("t")), t="  One here. Two there.") == "One here."
    long = one(spark, X.first_sentence(F.col("t")), t="x" * 400)
    assert len(long) == 280 and long.endswith("…")
