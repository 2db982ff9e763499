"""Places of an order against sorted lists, with bounds so small that every key needs rounds."""

import random

import pytest
from pyspark.sql import functions as F

from proofmark.operators.ranks import nearest_rank

R = random.Random(3)
KINDS = {
    "even": [R.random() for _ in range(4000)],
    "ties": [float(R.choice([1, 2, 3])) for _ in range(3000)],
    "ends": [0.0] * 2000 + [R.random() for _ in range(1000)] + [9.0] * 2000,
    "steep": [10.0 ** R.uniform(-300, 300) * R.choice([-1, 1]) for _ in range(3000)],
    "hot": [5.0] * 5000 + [R.gauss(5, 1) for _ in range(700)],
    "one": [7.0],
    "two": [1.0, 2.0],
    "same": [4.0] * 100,
    None: [float(i) for i in range(1500)],
}


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, v) for k, vs in KINDS.items() for v in vs] + [("even", None)] * 500 + [("void", None)]
    R.shuffle(made)
    return spark.createDataFrame(made, "kind string, x double").repartition(6).cache()


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95])
@pytest.mark.parametrize("most", [1, 40])
def test_places_equal_those_of_sorted_lists(rows, share, most):
    got = {r.kind: r.p for r in nearest_rank(rows, "x", share, "kind", most=most).collect()}
    assert got == {k: sorted(vs)[round(share * (len(vs) - 1))] for k, vs in KINDS.items()}


def test_without_keys_two_keys_and_whole_numbers(rows, spark):
    every = sorted(v for vs in KINDS.values() for v in vs)
    for most in (10, 100_000):
        assert nearest_rank(rows, "x", 0.77, most=most).first().p == every[round(0.77 * (len(every) - 1))]
    twice = spark.range(2000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, "b").alias("b"), (F.col("id") * 7919 % 2003).alias("v"))
    plain = {}
    for r in twice.collect():
        plain.setdefault((r.a, r.b), []).append(r.v)
    got = {(r.a, r.b): r.p for r in nearest_rank(twice, "v", 0.5, "a", "b", most=20).collect()}
    assert got == {k: sorted(v)[round(0.5 * (len(v) - 1))] for k, v in plain.items()}


def test_no_rows(spark):
    assert nearest_rank(spark.createDataFrame([], "k string, x double"), "x", 0.5, "k").collect() == []
    assert nearest_rank(spark.createDataFrame([], "x double"), "x", 0.5).collect() == []


def test_no_task_orders_more_than_the_bound(rows):
    """What reaches the window is within the bound, up to the error of the estimate of different values."""
    plan = nearest_rank(rows.where("kind = 'even'"), "x", 0.5, "kind", most=40)
    windows = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert windows
    low, high = 0.45, 0.55
    from proofmark.operators import ranks
    from proofmark.operators.stages import Stages

    by = rows.where("kind = 'even' and x is not null").select(F.col("kind").alias("key0"), F.col("x").alias("v"))
    start = by.groupBy("key0").agg(F.lit(2000).cast("long").alias("place")).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    with Stages(rows.sparkSession) as run:
        state = ranks._round(by, start, ["key0"], run, 0).first()
    assert low < state.low < state.high < high and state.d < 300
