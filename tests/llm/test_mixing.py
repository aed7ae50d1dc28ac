import pytest
from pyspark.sql import functions as F

from quarrylens.llm import mixing

TARGETS = "source string, target_share double, max_repeats int, text string"


def tables(spark, n=400):
    rows = [(i, f"s{i % 3}" if i % 10 else "rare", "word " * (1 + i % 9)) for i in range(n)] + [(9001, None, "x"), (9002, "other", "y z"), (9003, "s0", None), (9004, "s0", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("position", F.lit("clash"))
    goal = spark.createDataFrame([("s0", 0.3, 1, ""), ("s1", 0.3, 2, ""), ("s2", 0.2, 2, ""), ("rare", 0.15, 4, ""), ("absent", 0.05, 3, "")], TARGETS)
    return docs, goal


def test_shares_and_caps(spark):
    docs, goal = tables(spark)
    mix, report = mixing.mix(docs, goal)
    rows, rep = mix.collect(), {r.source: r for r in report.collect()}
    present = 0.95
    for s, share in (("s0", 0.3), ("s1", 0.3), ("s2", 0.2), ("rare", 0.15)):
        assert rep[s].actual_share == pytest.approx(share / present, abs=0.01) and rep[s].most_copies <= rep[s].max_repeats
    assert rep["absent"].tokens_used == 0 and rep[None].target_share is None and rep["other"].tokens_available > 0 and rep["other"].tokens_used == 0
    assert any(r.capped for r in rep.values())
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and all(0 <= r.position <= 1 for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    for s in ("s0", "rare"):  # every copy of a lower number is whole before a higher one starts
        top = max(r.copy for r in rows if r.source == s)
        whole = docs.filter((F.col("source") == s) & F.col("text").isNotNull()).count()
        assert all(sum(r.source == s and r.copy == c for r in rows) == whole for c in range(top))


def test_positions_follow_the_schedule(spark):
    docs, goal = tables(spark, 3000)
    late = {"s1": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]}
    rows = [r for r in mixing.mix(docs, goal, schedules=late)[0].collect() if r.source == "s1"]
    total = sum(r.n_tokens for r in rows)
    assert min(r.position for r in rows) > 0.49
    # weight rises linearly over the second half, so three quarters of the tokens lie beyond 0.75
    assert sum(r.n_tokens for r in rows if r.position > 0.75) / total == pytest.approx(0.75, abs=0.03)


def test_order_does_not_depend_on_partitions(spark):
    docs, goal = tables(spark)
    key = lambda df: [(r.doc_id, r.copy) for r in df.collect()]
    assert key(mixing.mix(docs.repartition(1), goal)[0]) == key(mixing.mix(docs.repartition(17), goal)[0])


def test_budget_and_edges(spark):
    docs, goal = tables(spark)
    report = {r.source: r for r in mixing.mix(docs, goal, budget=10**6)[1].collect()}
    assert report["rare"].tokens_used == 4 * report["rare"].tokens_available and report["rare"].capped
    assert mixing.mix(docs.limit(0), goal)[0].count() == 0 and mixing.mix(docs, goal.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, goal.unionByName(goal))


def test_plan():
    t = [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 1)]
    assert mixing.plan(t, {"a": 100, "b": 100, "c": 100}) == {"a": 100, "b": 50, "c": 50}
    assert mixing.plan(t, {"a": 100, "b": 100, "c": 10}, 200) == {"c": 10, "a": 100, "b": 90}
    assert mixing.plan(t, {}) == {}
    assert sum(w for _, w in (k[0] for k in mixing.ramps(t).values())) > 0


def test_tokens(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, "模型 <|endoftext|>")], "k int, t string")
    got = {r.k: r.n_tokens for r in mixing.count_tokens(df, ["k"], "t").collect()}
    enc = mixing._encoding(mixing.TOKENIZER)
    assert got == {1: len(enc.encode_ordinary("Hello world")), 2: 0, 3: len(enc.encode_ordinary("模型 <|endoftext|>"))}
