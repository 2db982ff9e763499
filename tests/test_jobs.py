"""The store of batch jobs: puts that replace, gets that read their own files."""

import pytest
from pyspark.sql import functions as F

from proofmark.operators.jobs import JobStore

DDL = "item_id string, batch_id string, x int"


@pytest.fixture()
def store(spark, tmp_path):
    return JobStore(spark, f"file://{tmp_path}/jobs", DDL)


def rows(spark, batch, n, x):
    return spark.createDataFrame([(f"i{i}", batch, x) for i in range(n)], DDL)


def held(df):
    return sorted((r.batch_id, r.item_id, r.x) for r in df.collect())


def test_a_second_put_replaces_a_batch_and_no_other(spark, store):
    assert held(store.all()) == [] and held(store.get("a")) == []
    store.put(rows(spark, "a", 3, 1).unionByName(rows(spark, "b", 2, 1)))
    store.put(rows(spark, "a", 2, 2))
    store.put(rows(spark, "a", 2, 2))
    store.put(rows(spark, "a", 0, 9))  # nothing to put
    assert held(store.get("a")) == [("a", "i0", 2), ("a", "i1", 2)]
    assert held(store.all()) == [("a", "i0", 2), ("a", "i1", 2), ("b", "i0", 1), ("b", "i1", 1)]
    assert held(store.get("a", "b", "none")) == held(store.all()) and held(store.get("none")) == []
    assert {r.batch_id: r.n for r in store.batches().collect()} == {"a": 2, "b": 2}
    store.put(rows(spark, "b", 1, 5))
    assert held(store.get("b")) == [("b", "i0", 5)]


def test_odd_names_repeats_and_numbers_of_files(spark, store, tmp_path):
    odd = ["2-HIGH", "a/b=c", "ü %", "007"]
    every = spark.createDataFrame([(f"i{i % 5}", b, i) for b in odd for i in range(20)] + [("i0", "007", 0)], DDL).repartition(6)
    store.put(every, files=1)
    assert len(list((tmp_path / "jobs").glob("*/*.parquet"))) == len(odd)
    for b in odd:
        assert store.get(b).count() == 20 + (b == "007")
    store.put(every, files=3)
    assert len(odd) <= len(list((tmp_path / "jobs").glob("*/*.parquet"))) <= 3 * len(odd) and store.all().count() == 81
    store.clear("a/b=c", "none")
    assert sorted(r.batch_id for r in store.batches().collect()) == sorted(b for b in odd if b != "a/b=c")
    store.clear()
    assert held(store.all()) == []
    store.clear()


def test_a_get_reads_its_own_files(spark, store):
    store.put(rows(spark, "a", 3, 1).unionByName(rows(spark, "b", 2, 1)).unionByName(rows(spark, "c", 2, 1)))
    got = store.get("b")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "batch_id#" in plan.split("PartitionFilters")[1]
    got.collect()
    scan = next(n for n in _nodes(got._jdf.queryExecution().executedPlan()) if "Scan" in n.nodeName())
    read = {k: v for k, v in ((x, scan.metrics().apply(x).value()) for x in ("numFiles", "numPartitions"))}
    assert read["numPartitions"] == 1 and read["numFiles"] >= 1


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_items_without_a_batch_are_refused(spark, store):
    with pytest.raises(Exception, match="an item has no batch_id"):
        store.put(spark.createDataFrame([("i", None, 1)], DDL))
