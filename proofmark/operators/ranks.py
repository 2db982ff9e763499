"""Places in an order, exactly, without ordering in one task what is large: values at a place, and rows with theirs.

Where a key has few different values they are counted and ordered in one task.  Where it
has many, the place is enclosed first: edges of ranges come from a sketch of the
key's values, exact counts say which range holds the place, and the next
round looks at that range alone.  Counts are combined within tasks, and a key's state is
one row, so no task sees more than ``most`` different values of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmark.operators.stages import Stages

#: Different values of a key that one task may order.
MOST = 100_000
#: Ranges of a round, and the sketch's accuracy (its error in ranks is one in so many).
RANGES, ACCURACY = 128, 2_000


def _within(v: Column, low: Column, high: Column) -> Column:
    """Strictly between two bounds; null is none."""
    return (low.isNull() | (v > low)) & (high.isNull() | (v < high))


def _joined(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their key's state; null keys are keys like others."""
    named = state.select(*(F.col(k).alias(f"{k}__") for k in keys), *(c for c in state.columns if c not in keys))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys))
    return rows.join(named, same).drop(*(f"{k}__" for k in keys))


def _direct(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the value at ``place`` (the same for all rows of a key), from running counts of distinct values."""
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.first("place").alias("place"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).where("upto > place").groupBy(*keys).agg(F.min("v").alias("p"))


def _round(rows: DataFrame, open_: DataFrame, keys: list[str], run: Stages, at: int) -> DataFrame:
    """The state of open keys after one round: narrower bounds, the place within them, or the value itself (``p``)."""
    v = F.col("v")
    inside = _joined(rows, open_, keys).where(_within(v, F.col("low"), F.col("high")))
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    sketched = inside.groupBy(*keys).agg(F.percentile_approx("v", shares, ACCURACY).alias("edges"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("place", "low", "high")))
    # The range in which the place should lie, and one more on either side for the sketch's error.
    near = F.floor((F.col("place") + 0.5) / F.col("n") * RANGES).cast("int")
    edge = lambda i: F.when(i.between(0, RANGES - 2), F.get("edges", i))
    bounds = run.store(f"edges-{at}", sketched.select(*keys, "place", "low", "high", edge(near - 2).alias("a"), edge(near + 1).alias("b")), keep=True)
    a, b = F.col("a"), F.col("b")
    between = _within(v, a, b)
    counted = (
        _joined(rows, bounds, keys)
        .where(_within(v, F.col("low"), F.col("high")))
        .groupBy(*keys)
        .agg(
            *(F.first(c).alias(c) for c in ("place", "low", "high", "a", "b")),
            F.count_if(F.coalesce(v < a, F.lit(False))).alias("below"),
            F.count_if(F.coalesce(v == a, F.lit(False))).alias("at_a"),
            F.count_if(between).alias("between"),
            F.count_if(F.coalesce((v == b) & ~b.eqNullSafe(a), F.lit(False))).alias("at_b"),
            F.approx_count_distinct(F.when(between, v)).alias("d"),
        )
    )
    place = F.col("place")
    first, second, third = F.col("below"), F.col("below") + F.col("at_a"), F.col("below") + F.col("at_a") + F.col("between")
    fourth = third + F.col("at_b")
    part = F.when(place < first, 0).when(place < second, 1).when(place < third, 2).when(place < fourth, 3).otherwise(4)
    pick = lambda *c: reduce(lambda w, x: w.when(F.col("part") == x[0], x[1]), enumerate(c[1:], 1), F.when(F.col("part") == 0, c[0]))
    return counted.withColumn("part", part).select(
        *keys,
        pick(place, place, place - second, place, place - fourth).alias("place"),
        pick(F.col("low"), F.col("low"), a, F.col("low"), b).alias("low"),
        pick(a, F.col("high"), b, F.col("high"), F.col("high")).alias("high"),
        F.when(F.col("part") == 1, a).when(F.col("part") == 3, b).alias("p"),
        F.when(F.col("part") == 2, F.col("d")).otherwise(F.lit(None).cast("long")).alias("d"),
    )


def nearest_rank(df: DataFrame, value: str, share: float, *keys: str, most: int = MOST) -> DataFrame:
    """The value at place round(share * (n - 1)), halves to even, per key, as ``p``: no interpolation.

    Nulls don't count; a key without values has no row.  Without keys there is one
    row.  ``most`` bounds the different values of a key that a task orders; whatever it is, the
    result is the same.
    """
    spark, run = df.sparkSession, Stages(df.sparkSession)
    by = [f"key{i}" for i in range(len(keys))] or ["key0"]
    kept = [F.col(k).alias(x) for k, x in zip(keys, by, strict=True)] if keys else [F.lit(0).alias("key0")]
    rows = df.where(F.col(value).isNotNull()).select(*kept, F.col(value).alias("v"))
    place = F.bround(F.lit(share) * (F.count("*") - 1), 0).cast("long")
    sizes = run.store("sizes", rows.groupBy(*by).agg(place.alias("place"), F.approx_count_distinct("v").alias("d")), keep=True)
    none = F.lit(None).cast(rows.schema["v"].dataType)
    begun = sizes.withColumns({"low": none, "high": none})
    ready, open_ = begun.where(F.col("d") <= most).drop("d"), begun.where(F.col("d") > most).drop("d")
    found, at = sizes.select(*by, none.alias("p")).limit(0), 0
    while not open_.isEmpty():
        state = run.store(f"state-{at}", _round(rows, open_, by, run, at), keep=True)
        found = found.unionByName(state.where("p is not null").select(*by, "p"))
        left = state.where("p is null").drop("p")
        small = F.coalesce(F.col("d") <= most, F.lit(False))
        ready = ready.unionByName(left.where(small).drop("d"))
        open_, at = left.where(~small).drop("d"), at + 1
    in_range = _joined(rows, ready, by).where(_within(F.col("v"), F.col("low"), F.col("high"))).select(*by, "v", "place")
    told = _direct(in_range, by).unionByName(found)
    return told.select(*(F.col(x).alias(k) for k, x in zip(keys, by)), "p")


def numbered(df: DataFrame, name: str, *order: str, ranges: int | None = None) -> DataFrame:
    """Rows with their place, from 1, in the order of the columns: rows are dealt into ranges and numbered within each.

    The ranges are stored first, since their bounds come from a sample; what lies
    before each range is a sum over one row per range.  Rows that are equal in all
    columns of the order may take each other's place.
    """
    spark, run = df.sparkSession, Stages(df.sparkSession)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = run.store("ranges", df.repartitionByRange(n, *order).withColumn("range__", F.spark_partition_id()), keep=True)
    sizes = dealt.groupBy("range__").agg(F.count("*").alias("n__"))
    before = sizes.withColumn("before__", F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))).drop("n__")
    own = F.row_number().over(Window.partitionBy("range__").orderBy(*order))
    placed = dealt.withColumn("own__", own).join(F.broadcast(before), "range__")  # one row per range
    return placed.withColumn(name, (F.coalesce("before__", F.lit(0)) + F.col("own__")).cast("long")).drop("range__", "own__", "before__")
