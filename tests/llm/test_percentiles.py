import math
import random

from pyspark.sql import functions as F

from marlstone.llm.percentiles import bisect, combined, located, long_values, summaries

KEYS = ["g", "metric"]
Q = [0, 10, 500, 990, 1000]


def test_random_values_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(1, 3), rng.choice([None, float("nan"), 0.0, -0.0, 7.25, -3.5, math.inf, -math.inf, 1.7e308, rng.gauss(0, 1), rng.random() * 10 ** rng.randint(-12, 15)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, day int, x double").withColumn("n", F.lit(9)).withColumn("bucket", F.lit("own"))
    values = long_values(df, ["g", "day"], {"x": "true"}).groupBy("g", "day", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    start = located(combined(summaries(values, ["day", *KEYS]), KEYS), KEYS, Q)
    got = {(r["g"], r["permille"]): (r["total"], r["value"]) for r in bisect(values, start, KEYS).collect()}
    bounds = {(r["g"], r["permille"]): (r["lo"], r["hi"]) for r in start.collect()}
    for g in ("a", "b", None):
        own = sorted(x for k, _, x in rows if k == g and x is not None and not math.isnan(x))
        for q in Q:
            want = own[max(1, -(-q * len(own) // 1000)) - 1]
            total, value = got[g, q]
            assert total == len(own) and value == want
            lo, hi = bounds[g, q]
            assert lo <= want <= hi and (lo == hi or hi - lo <= 0.0111 * (1 + max(abs(lo), abs(hi))))


def test_one_value_and_empty(spark):
    one = spark.createDataFrame([("a", 1, 4.0)] * 5, "g string, day int, x double")
    values = long_values(one, ["g", "day"], {"x": "true"}).withColumn("n", F.lit(1))
    start = located(combined(summaries(values, ["day", *KEYS]), KEYS), KEYS, [500])
    assert [r["value"] for r in bisect(values, start, KEYS).collect()] == [4.0]
    none = values.limit(0)
    assert bisect(none, located(combined(summaries(none, ["day", *KEYS]), KEYS), KEYS, [500]), KEYS).count() == 0
