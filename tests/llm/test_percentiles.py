import random
from math import ceil

from pyspark.sql import functions as F

from quarrylens.llm import percentiles as P

PS = [0.1, 0.5, 0.999]


def exact(values, p):
    v = sorted(values)
    return v[max(1, ceil(round(p * len(v), 9))) - 1]


def test_error_is_within_the_bound_and_states_merge(spark):
    rnd = random.Random(1)
    rows = [(g, day, int(rnd.lognormvariate(9, 2)) * (1 if g != "neg" else -1)) for g in ("a", None, "neg") for day in range(4) for _ in range(700)]
    rows += [("one", 0, 7)] * 5 + [("huge", 0, 2**62), ("huge", 1, 3), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v bigint").withColumn("cum", F.lit("clash"))
    daily = P.summarize(df, ["g", "day"], "v")
    for state in (P.summarize(df, ["g"], "v"), P.merge(daily, ["g"])):
        got = {r.g: r for r in P.percentiles(state, ["g"], PS).collect()}
        assert set(got) == {"a", None, "neg", "one", "huge"}
        for g, r in got.items():
            mine = [v for x, _, v in rows if x == g and v is not None]
            assert r.n == len(mine)
            for p, name in zip(PS, ("p10", "p50", "p99_9")):
                true = exact(mine, p)
                assert abs(r[name] - true) <= r.error_bound and abs(r[name] - true) <= abs(true) * 2**-P.BITS + 0.5
        assert got["one"].error_bound == 0


def test_repeats_count_once(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("a", None, 9), ("a", None, 9)], "g string, k int, v int")
    assert {(r.bin, r.n) for r in P.summarize(df, ["g"], "v", once=["k"]).collect()} == {(5, 2), (9, 1)}


def test_nulls_in_the_naming_columns(spark):
    df = spark.createDataFrame([("g", "a", None, 5), ("g", None, "a", 5)], "g string, x string, y string, v int")
    assert P.summarize(df, ["g"], "v", once=["x", "y"]).first().n == 2


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert P.percentiles(P.summarize(df, ["g"], "v"), ["g"], PS).count() == 0
    assert P.percentiles(P.summarize(spark.createDataFrame([("a", None)], "g string, v int"), ["g"], "v"), ["g"], PS).count() == 0


def test_one_group_over_many_partitions(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    r = P.percentiles(P.summarize(df, ["g"], "v"), ["g"], [0.25]).first()
    assert abs(r.p25 - 49_999) <= r.error_bound
