"""Batch items as a stream: late, repeated and missing events, and runs that go on from a checkpoint."""

import json
import os
import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from proofmark.streaming import live

START = datetime(2024, 5, 1, 8, 0, tzinfo=timezone.utc)
R = random.Random(6)


def event(item, kind, minute, **more):
    return {"batch_id": f"b{item % 3}", "item_id": f"i{item}", "event": kind, "ts": (START + timedelta(minutes=minute)).isoformat(), **more}


def put(folder, name, events):
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps(e) + "\n" for e in R.sample(events, len(events)))
    (folder / f".{name}").write_text(text)
    (folder / f".{name}").rename(folder / name)


def run(spark, tmp, **more):
    made = live.moves(live.arrivals(spark, f"file://{tmp}/in", 1), **more)
    live.follow(made, f"file://{tmp}/moves", f"file://{tmp}/checkpoint").awaitTermination()
    rows = live.read(spark, f"file://{tmp}/moves").collect()
    return sorted((r.item_id, r.state, round((r.at.replace(tzinfo=r.at.tzinfo or timezone.utc) - START).total_seconds() / 60), r.error_code) for r in rows)


def test_each_item_passes_each_state_once_over_restarts(spark, tmp_path):
    first, second, third = [], [], []
    for i in range(40):
        queued, started, end = event(i, "queued", 0), event(i, "started", 1 + i % 3), event(i, "failed", 5, error_code="ocr_unavailable", processing_time_ms=2.0) if i % 4 == 0 else event(i, "finished", 5, overall_status="PASS", processing_time_ms=3.0)
        if i < 10:  # in order, all at once, and repeated later on
            first += [queued, started, end, started, end]
            second += [queued, started, end]
        elif i < 20:  # over the runs
            first += [queued]
            second += [started, queued]
            third += [end, end, started]
        elif i < 30:  # the end comes first
            first += [end]
            second += [started, queued]
        else:  # started, never ended
            second += [started, started]
    put(tmp_path / "in", "1.json", first + [{"batch_id": "b0", "item_id": "i0", "event": "unheard of", "ts": START.isoformat()}, {"batch_id": "b0", "item_id": "i1", "event": "failed"}])
    run(spark, tmp_path)
    put(tmp_path / "in", "2.json", second)
    run(spark, tmp_path)
    run(spark, tmp_path)  # nothing new
    put(tmp_path / "in", "3.json", third + [event(1000, "queued", 100)])
    run(spark, tmp_path)
    put(tmp_path / "in", "4.json", [event(1001, "queued", 200), event(35, "finished", 190, overall_status="PASS")])
    got = run(spark, tmp_path)
    expected = [("i1000", "QUEUED", 100, None), ("i1001", "QUEUED", 200, None)]
    for i in range(40):
        end = ("ERROR", 5, "ocr_unavailable") if i % 4 == 0 else ("COMPLETED", 5, None)
        if i < 20:
            expected += [(f"i{i}", "QUEUED", 0, None), (f"i{i}", "PROCESSING", 1 + i % 3, None)]
        if i < 30:
            expected += [(f"i{i}", *end)]
        else:
            expected += [(f"i{i}", "PROCESSING", 1 + i % 3, None), (f"i{i}", "ERROR", 31 + i % 3, live.TIMEOUT)]
    assert got == sorted(expected)
    standing = live.now(live.read(spark, f"file://{tmp_path}/moves"))
    assert standing.count() == 42 and standing.where("processing_state = 'PROCESSING'").isEmpty()
    jobs = {r.batch_id: r for r in live.jobs(standing).collect()}
    assert sum(r.total for r in jobs.values()) == 42 and {k: r.state for k, r in jobs.items()} == {"b0": "COMPLETED", "b1": "PROCESSING", "b2": "PROCESSING"}
    assert jobs["b1"].queued == 1 and jobs["b0"].error + jobs["b0"].completed == jobs["b0"].total


def test_a_micro_batch_written_twice_counts_once(spark, tmp_path):
    put(tmp_path / "in", "1.json", [event(i, "queued", 0) for i in range(5)])
    run(spark, tmp_path)
    # What is left of a run that broke off while it wrote the next micro-batch.
    epoch = 1 + max(int(f.name.split("=")[1]) for f in (tmp_path / "moves").glob("epoch=*"))
    spark.range(3).select(F.lit("b0").alias("batch_id"), F.lit("half").alias("item_id")).write.parquet(f"file://{tmp_path}/moves/epoch={epoch}")
    put(tmp_path / "in", "2.json", [event(i, "started", 1) for i in range(5)])
    got = run(spark, tmp_path)
    assert [g[:2] for g in got] == sorted([(f"i{i}", s) for i in range(5) for s in ("QUEUED", "PROCESSING")])


def test_items_move_in_shares_as_they_do_alone(spark, tmp_path):
    """Ties, repeats, limits met to the minute, ends that are forgotten and items that begin anew; times taken that are none or not a number."""
    r = random.Random(3)
    for at, clock in enumerate((0, 25, 50, 75, 100, 160)):
        events = [event(1000 + at, "queued", clock + 20)]
        for i in r.sample(range(60), 45):
            kind = r.choice(list(live.STATES))
            more = {"queued": {}, "started": {}, "finished": {"overall_status": r.choice(["PASS", "FAIL", None])}, "failed": {"error_code": r.choice(["ocr_unavailable", "", None])}}[kind]
            took = {"processing_time_ms": r.choice([None, 0.1 + i, float("nan")])} if i % 2 else {"processing_time_ms": i / 3}
            made = event(i, kind, clock + r.choice([-15, 0, 5, 10, 20]), **more, **took) | ({"batch_id": None} if i % 7 == 0 else {})
            events += [made] * r.choice([1, 1, 2]) + [event(i, r.choice(["queued", "started"]), clock + r.choice([0, 5]))] * r.choice([0, 1])
        for run_of in ("alone", "shares"):
            (tmp_path / run_of).mkdir(exist_ok=True)
            put(tmp_path / run_of / "in", f"{at}.json", events)
            os.utime(tmp_path / run_of / "in" / f"{at}.json", (1_700_000_000 + at,) * 2)
    found = {}
    for run_of, shares in (("alone", None), ("shares", 5)):
        at = f"file://{tmp_path}/{run_of}"
        query = live.follow(live.moves(live.arrivals(spark, f"{at}/in", 1), limit_minutes=30, keep_minutes=40, shares=shares), f"{at}/moves", f"{at}/checkpoint", parts=2)
        query.awaitTermination()
        rows = live.read(spark, f"{at}/moves").select("epoch", "batch_id", "item_id", "state", F.unix_millis("at"), "overall_status", "processing_time_ms", "error_code").collect()
        found[run_of] = sorted(str(tuple(x)) for x in rows)
        stored = max(op["numRowsTotal"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])
        assert stored <= 3 * 5 if shares else stored > 60  # a state, and a timer twice over
    assert found["alone"] == found["shares"]
    assert any(live.TIMEOUT in x for x in found["shares"]) and any("nan" in x for x in found["shares"])
    again = [(x.item_id, x.n) for x in live.read(spark, f"file://{tmp_path}/shares/moves").where("state = 'COMPLETED'").groupBy("item_id").agg(F.count("*").alias("n")).collect()]
    assert max(n for _, n in again) > 1  # forgotten in between


def test_a_share_makes_its_round_trips_once():
    calls, kept, timers = [], [None], set()
    lives = live.Lives(1000, 5000)
    lives.state = SimpleNamespace(get=lambda: calls.append("get") or kept[0], update=lambda x: calls.append("update") or kept.__setitem__(0, x), clear=lambda: calls.append("clear") or kept.__setitem__(0, None))
    lives.handle = SimpleNamespace(deleteTimer=lambda t: calls.append("delete") or timers.remove(t), registerTimer=lambda t: calls.append("register") or timers.add(t))
    events = lambda kind, ms: pd.DataFrame([("b", f"i{i}", kind, ms + i, None, None, None) for i in range(100)], columns=live.CAME)
    for kind, ms, left, made in (("queued", 0, set(), ["get", "update"]), ("started", 10, {1010}, ["get", "update", "register"]), ("started", 20, {1010}, ["get"]), ("finished", 30, {5030}, ["get", "update", "delete", "register"])):
        calls.clear()
        told = list(lives.handleInputRows((0,), iter([events(kind, ms)]), None))
        assert (timers, calls, sum(map(len, told))) == (left, made, 100 if "update" in made else 0)
    for reached, items in ((5030, 99), (5128, 1), (5129, 0)):
        timers.clear()
        assert list(lives.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: reached), None)) == []  # noqa: B023
        assert len(kept[0][0]) == items if items else kept[0] is None
        assert timers == ({reached + 1} if items else set())
