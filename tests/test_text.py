import random
from collections import Counter
from math import isqrt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.plans import pipeline


def one(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_cleaners(spark):
    assert one(spark, ["<p>a &amp; b</p><script>x<y</script>c", None, ""], T.clean_html) == ["a & bc", None, ""]
    assert one(spark, ["see https://a.b/c?d=1 now www.x.org"], T.clean_links) == ["see  now "]
    assert one(spark, ["mail a.b+c@d.example today"], T.clean_email) == ["mail  today"]
    assert one(spark, ["　a  b\n"], T.normalize_whitespace) == ["a  b"]
    assert one(spark, ["é", None], T.fix_unicode) == ["é", None]
    assert one(spark, ["cafÃ©", "café", "plain"], T.fix_mojibake) == ["café", "café", "plain"]


def test_cleaners_are_idempotent(spark):
    texts = ["<b>x</b>   y", " a@b.example ", "é　"]
    for f in (T.clean_html, T.clean_email, T.normalize_whitespace, T.fix_unicode):
        once = one(spark, texts, f)
        assert one(spark, once, f) == once


def test_bounds_and_ratios(spark):
    assert one(spark, ["x" * n for n in (49, 50, 10_000, 10_001)], T.length_between) == [False, True, True, False]
    assert one(spark, ["ab1.", "", None, "日本 "], T.alnum_ratio) == [0.75, None, None, pytest.approx(2 / 3)]
    assert one(spark, ["a b!", ""], T.special_ratio) == [0.25, None]


def brute_repetition(t, n):
    grams = Counter(t[i : i + n] for i in range(len(t) - n + 1))
    single = sum(v == 1 for v in grams.values())
    return sum(v for _, v in grams.most_common(min(isqrt(len(grams)), len(grams) - single))) / sum(grams.values())


def test_repetition(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab ") for _ in range(80)) for _ in range(20)] + ["abcdefghij" * 30]
    assert one(spark, texts, T.char_repetition) == pytest.approx([brute_repetition(t, 10) for t in texts])
    assert one(spark, ["short", "", None], T.char_repetition) == [0.0, 0.0, None]


def test_pipeline_folds_in_order_and_refuses_unknown_names(spark):
    df = spark.createDataFrame([(1, "<p>" + "word " * 20 + "</p>"), (2, "short"), (3, None), (4, "word " * 20)], "doc_id int, text string")
    steps = [{"clean_html": {}}, {"normalize_whitespace": {}}, {"text_length": {"min_len": 10}}, {"minhash_dedup": {}}]
    assert [r["doc_id"] for r in pipeline.run(df, steps).collect()] == [1]
    with pytest.raises(ValueError, match="unknown operator"):
        pipeline.run(df, [{"nonsense": {}}])
