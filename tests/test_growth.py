"""Work that must not grow with the place where it is asked for: records are dealt over the cores, shared values worked out once."""

import os

import pytest
from pyspark.sql import functions as F

from proofmark.config import EDGE_JUNK, FIELDS, NET_PATTERN, OCR_ARTIFACT, PROOF_PATTERN, WEAK_STANDALONE
from proofmark.functions import parse
from proofmark.functions.text import comparison_normalize, lines, strip
from proofmark.operators import extract, rules
from proofmark.operators.stages import Stages
from proofmark.plans.labels import labels, odd_labels
from proofmark.plans.queries import records
from proofmark.plans.runs import alcohol_fields

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@data
@pytest.mark.parametrize("of", [labels, odd_labels])
def test_records_of_one_small_file_are_dealt_over_all_cores(spark, of):
    rows = of(spark, DATA).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() >= spark.sparkContext.defaultParallelism


def test_a_rule_makes_each_key_once(spark):
    df = spark.createDataFrame([("class_type", "Vodka", "GOOD", "FOUND", "a  VODKA`s", None, None, None, [], None, None)], "field_name string, app_value string, quality string, status string, raw_text string, normalized_value string, normalized_numeric double, normalized_unit string, candidates array<string>, reason string, source string")
    done = rules.run(df)
    assert "a-z0-9'" not in plan(done)
    assert done.select("status").first()[0] == "REVIEW"


def test_keys_and_stripping(spark):
    cases = {" The  Oak`s\x1fHILL ": "the oak's hill", "Ñandú": "and", "ﬁne ＡＢ": "fine ab", "==": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", comparison_normalize("t")).collect()) == cases
    odd = ["\x1c a　", "\x85 b c ", "", " \t\n", None, "a"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").coalesce(1).select(strip(F.col("t"))).collect()] == [t if t is None else t.strip() for t in odd]


def test_a_timer_is_set_without_a_look_at_all_timers():
    from types import SimpleNamespace

    from proofmark.streaming.live import Life

    calls, kept = [], [None]
    state = SimpleNamespace(exists=lambda: calls.append("exists") or kept[0] is not None, get=lambda: calls.append("get") or kept[0], update=lambda x: calls.append("update") or kept.__setitem__(0, x))
    timers = set()
    life = Life(1000, 5000)
    life.handle = SimpleNamespace(listTimers=lambda: calls.append("list") or list(timers), deleteTimer=timers.remove, registerTimer=timers.add)
    life.state = state
    event = lambda name, ms: SimpleNamespace(event=name, ms=ms, error_code=None, overall_status=None, processing_time_ms=None)
    for name, ms, left in (("queued", 0, set()), ("started", 10, {1010}), ("started", 20, {1010}), ("finished", 30, {5030})):
        list(life.handleInputRows(("b", "i"), [event(name, ms)], None))
        assert timers == left
    assert "list" not in calls and "exists" not in calls


def test_keys_of_more_texts_than_are_read_at_once(spark):
    from pyspark.util import PythonEvalType

    assert comparison_normalize.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    df = spark.range(0, 700, 1, 1).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("É "), F.col("id").cast("string"))).alias("t"))
    assert [r[0] for r in df.select(comparison_normalize("t")).collect()] == [f"{i}" if i % 3 else None for i in range(700)]


@data
def test_one_field_is_worked_out_without_the_others(spark):
    """The same rows as among all fields; the stage that answers are merged with has no others."""
    base = records(spark, DATA, odd_labels)
    one, every = extract.fields(base, ["alcohol_content"]), extract.fields(base)
    told = lambda df: sorted(map(str, df.select("item_id", "field_at", "field_name", "status", "raw_text", "normalized_value", "normalized_numeric", "candidates", "reason", "source").collect()))
    assert told(one) == told(every.where("field_name = 'alcohol_content'")) != []
    assert "net_contents_pattern_missing" in plan(every) and "net_contents_pattern_missing" not in plan(one)
    run = Stages(spark)
    assert alcohol_fields(spark, DATA, run).count() == run.timings().first()["n_rows"]


def test_lambdas_name_each_pattern_once(spark):
    """What a lambda names twice is worked out twice."""
    df = spark.createDataFrame([("Oak Hill\nDistillery\n5 % alcohol", None, 600)], f"t string, w {extract.WORDS}, h int")
    scores = df.select(extract.brand_scores(F.col("t"), F.col("w"), F.col("h")).alias("x"))
    assert [plan(scores).count(p) for p in (WEAK_STANDALONE, OCR_ARTIFACT, EDGE_JUNK)] == [1, 1, 1]
    assert plan(df.select(parse.alcohol(F.col("t")).alias("x"))).count(PROOF_PATTERN) == 1
    assert plan(df.select(parse.net(F.col("t")).alias("x"))).count(NET_PATTERN) == 1


def test_fields_are_columns_before_they_are_rows(spark):
    """The generator only puts them together, so Spark compiles it; other columns may have any name."""
    df = spark.createDataFrame([("a", "OAK HILL\n40% ABV", None, 800, 600, 1)], f"item_id string, full_text string, words {extract.WORDS}, image_width_px int, image_height_px int, `text.lines` int")
    made = extract.fields(df)
    assert "lambda" not in next(x for x in plan(made).splitlines() if "Generate explode" in x)
    assert [(r.field_name, r.status, r["text.lines"]) for r in made.collect()] == [(n, s, 1) for n, s in zip(FIELDS, ("FOUND", "NOT_FOUND", "FOUND", "NOT_FOUND", "NOT_FOUND"), strict=True)]


def test_statements_in_every_form_the_patterns_take(spark):
    """Texts that none of the patterns can match aren't tried; those that one matches are."""
    cases = {"5 % Alc./Vol.": 5.0, "7 alcohol by volume": 7.0, "ABV: 9": 9.0, "alc. 11% by vol.": 11.0, "13% ALCOHOL": 13.0, "15 % alc": 15.0, "(1) alcoholic beverages": None, "Strong": None, "90 proof, alcoholic": 45.0}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", parse.alcohol(F.col("t"))["abv"]).collect()) == cases


@data
def test_requests_store_the_fields_alone(spark, monkeypatch):
    """Checks go into the aggregate as they are judged."""
    import __spark_entry__ as entry

    stored, store = [], Stages.store
    monkeypatch.setattr(Stages, "store", lambda self, name, *a, **k: stored.append(name) or store(self, name, *a, **k))
    assert entry.queries()["rec_10_requests"](spark, DATA).count() > 0
    assert stored == ["fields"]


def test_lines_are_cut_at_single_signs(spark):
    """One class of signs is looked for; what a pair leaves between is empty, and dropped."""
    df = spark.createDataFrame([("a\r\nb\rc\n\n d \x1de\x85f\u2028g\r\n",)], "t string").select(lines(F.col("t")).alias("x"))
    assert "\\r\\n|" not in plan(df)
    assert df.first()[0] == list("abcdefg")


def test_keywords_are_looked_for_only_where_no_phrase_is(spark):
    df = spark.createDataFrame([("Straight Bourbon Whiskey\nold rye",), ("old rye\nscotch",), ("Oak",)], "t string").select(extract.class_type(F.col("t")).alias("f"))
    assert "THEN filter(" in plan(df)
    assert [(r.f.status, r.f.raw_text, r.f.candidates) for r in df.collect()] == [("FOUND", "Straight Bourbon Whiskey", ["Straight Bourbon Whiskey"]), ("UNCERTAIN", "old rye", ["old rye", "scotch"]), ("NOT_FOUND", None, [])]


@data
def test_a_query_on_small_records_uses_all_cores(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["joi_11_adjacent_fragment"](spark, DATA).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() >= spark.sparkContext.defaultParallelism


@data
def test_the_lifecycle_keeps_states_of_shares_and_few_files(spark, monkeypatch):
    """Each wave is few files and one micro-batch, into however many partitions records are dealt."""
    import __spark_entry__ as entry
    from proofmark.streaming import live

    moves, follow, shares, files, filled, before = live.moves, live.follow, [], [], [], spark.conf.get("spark.sql.shuffle.partitions")

    def arrivals(spark, path, most):
        files.append(sum(f.endswith(".json") for f in os.listdir(path.removeprefix("file://"))))
        return live_arrivals(spark, path, most)

    def followed(*a, **k):
        query = follow(*a, **k)
        query.awaitTermination()
        filled.append(sum(p["numInputRows"] > 0 for p in query.recentProgress))
        return query

    live_arrivals = live.arrivals
    monkeypatch.setattr(live, "arrivals", arrivals)
    monkeypatch.setattr(live, "moves", lambda *a, **k: shares.append(k.get("shares")) or moves(*a, **k))
    monkeypatch.setattr(live, "follow", followed)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = entry.queries()["svc_01_lifecycle"](spark, DATA).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n == 3 * labels(spark, DATA).count()
    assert all(shares) and len(shares) == 3 and filled == [1, 1, 1] and files[-1] <= 3 * 16
