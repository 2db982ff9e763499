"""Reports as rows, settings from a file, and scripts."""

import pytest
from pyspark.sql import functions as F

from proofmark.config import Settings, dotenv
from proofmark.operators import evaluate, exports, reconcile

TRIAL = "provider string, profile string, edge int, success boolean, failure_kind string, fields_recovered int, cer double, total_ms double, has_boxes boolean, field_recovery map<string,boolean>"
ASKED = {"generated": "now", "environment": {"os": "any"}, "requested": [], "available": ["a"], "unavailable": {}, "profiles": ["fast"], "edges": [1600]}


def text(rows):
    return [r.line for r in rows.orderBy("section", "place").collect()]


def test_report_of_good_trials_reads_in_order(spark, tmp_path):
    made = [("b", "fast", 1600, True, None, 4, 0.25, 100.5, True, {"brand_name": True}), ("a", "fast", 1600, True, None, 4, None, 101.5, False, {"brand_name": None}), ("a", "fast", 1600, True, None, 5, 0.125, 2.5, True, {"net_contents": True})]
    rows = evaluate.report(spark.createDataFrame(made, TRIAL), **ASKED)
    expected = [
        *["# OCR Evaluation Summary", "", "Generated: `now`", "", "## Environment", "- **os:** any", "", "## Providers", "- Requested: (none)", "- Available: a", "", "Profiles: fast; max edges: 1600", ""],
        *[evaluate.HEADINGS[3], "", *evaluate.BOARD_HEAD, "| a | fast | 1600 | 4.50 | 0.125 | 52 | 97 | 0.50 | 1.00 |", "| b | fast | 1600 | 4.00 | 0.250 | 100 | 100 | 1.00 | 1.00 |", ""],
        *[evaluate.HEADINGS[4], "", "| Provider | " + " | ".join(evaluate.RECOVERED) + " |", "|---|---:|---:|---:|---:|---:|", "| a | 0.00 | 0.00 | 0.00 | 0.50 | 0.00 |", "| b | 1.00 | 0.00 | 0.00 | 0.00 | 0.00 |", ""],
        *[evaluate.HEADINGS[5], "", "- **fast:** mean fields=4.33, median total=100 ms, mean CER=0.188", "", evaluate.HEADINGS[6], "", "- **1600px:** mean fields=4.33, median total=100 ms", "", evaluate.HEADINGS[7], "", evaluate.NO_FAILURES, ""],
        *[evaluate.HEADINGS[8], "", "Top configuration by field recovery then latency: **a / fast / 1600px** (mean fields 4.50/5, median 52 ms).", "Best config with median total <= 2000 ms and mean fields >= 3.0: **a / fast / 1600px** (mean fields 4.50, median 52 ms).", ""],
    ]
    assert text(rows) == expected
    evaluate.write_report(rows, f"file://{tmp_path}/report")
    assert next((tmp_path / "report").glob("*.txt")).read_text().splitlines() == expected
    slow = evaluate.report(spark.createDataFrame([("a", "fast", 1600, False, None, 1, None, 9000.0, False, {})], TRIAL), **ASKED)
    assert {"- `unknown`: 1", evaluate.OVER_BUDGET} <= set(text(slow)) and evaluate.NO_FAILURES not in text(slow)
    assert text(evaluate.report(spark.createDataFrame([], TRIAL), **ASKED))[-1] == evaluate.NO_TRIALS


def test_single_report_has_all_rows_of_every_item(spark):
    items = spark.createDataFrame([(1, "R1", "f.jpg", "LABEL_ONLY", "PASS", 1.25, True, 1, 0, 0), (2, "R2", "=g.jpg", "LABEL_ONLY", "REVIEW", 0.05, False, 0, 1, 0)], "item_id long, review_id string, filename string, mode string, overall_status string, processing_time_ms double, ai_assisted boolean, pass_count long, review_count long, fail_count long")
    items = items.withColumn("generated", F.timestamp_seconds(F.lit(0)))
    fields = spark.createDataFrame([(1, "government_warning", "UNCERTAIN", None, None, "unclear"), (1, "brand_name", "FOUND", "", "Oak", None), (2, "government_warning", "FOUND", None, None, None), (9, "brand_name", "FOUND", "x", "x", None)], "item_id long, field_name string, status string, raw_text string, normalized_value string, explanation string")
    checks = spark.createDataFrame([(1, 1, "Net Contents", "PASS", "-1 L", "ok", None, None), (1, 0, "Brand Name", "PASS", None, "ok", "BRAND_MATCH", True)], "item_id long, field_at int, check_name string, status string, detected_value string, explanation string, reason_code string, ai_assisted_evidence boolean")
    rows = {}
    for r in exports.single_rows(items, fields, checks).orderBy("item_id", "at").collect():
        rows.setdefault(r.item_id, []).append((r.section, list(r.cells)))
    assert [r[1] for r in rows[1][:4]] == [["Review metadata"], ["Review ID", "R1"], ["Generated (UTC)", "1970-01-01 00:00:00"], ["Filename", "f.jpg"]]
    assert dict(r[1] for r in rows[1] if r[0] == "fields" and len(r[1]) == 2) == {"Brand Name": "Oak", "Class / Type": "Not extracted", "Alcohol Content": "Not extracted", "Net Contents": "Not extracted", "Government Warning": "UNCERTAIN: unclear"}
    assert [r[1] for r in rows[1][-3:]] == [list(exports.CHECK_COLUMNS), ["Brand Name", "PASS", "", "ok", "BRAND_MATCH", "Yes"], ["Net Contents", "PASS", "'-1 L", "ok", "", "No"]]
    assert len(rows[2]) == 19 and ("metadata", ["Filename", "'=g.jpg"]) in rows[2] and ("fields", ["Government Warning", "Detected"]) in rows[2] and set(rows) == {1, 2}


def test_settings_from_a_file_give_way_to_the_environment(tmp_path, monkeypatch):
    file = tmp_path / ".env"
    file.write_text('# limits\n\nPROOFMARK_BRAND_PASS=91.5 # lower\nexport proofmark_batch_max_items="12"\nPROOFMARK_ABV_EPSILON=\'0.1\'\nPROOFMARK_NO_SUCH=1\nnot a setting\nQUOTED="a # b"\n', encoding="utf-8")
    assert dotenv(str(file))["QUOTED"] == "a # b"
    s = Settings.from_env(str(file))
    assert (s.brand_pass, s.batch_max_items, s.abv_epsilon, s.brand_review) == (91.5, 12, 0.1, 85.0)
    monkeypatch.setenv("PROOFMARK_BRAND_PASS", "99")
    assert Settings.from_env(str(file)).brand_pass == 99.0 and Settings.from_env().batch_max_items == 300
    assert Settings.from_env(str(tmp_path / "none")).batch_max_items == 300


def test_scripts_are_bounded_and_need_no_join(spark, monkeypatch):
    asked = spark.createDataFrame([(1, [("brand_name",)]), (2, [("class_type",)]), (3, [])], "item_id long, fields array<struct<field:string>>")
    script = spark.createDataFrame([("brand_name", "A", None), ("brand_name", "B", 2), ("net_contents", "C", 3)], "field_name string, candidate_value string, n int")
    told = reconcile.scripted_evidence(asked, script)
    assert sorted(map(tuple, told.collect()), key=str) == sorted([(1, "brand_name", "A", None), (1, "brand_name", "B", 2), *((i, *r) for i in (2, 3) for r in (("brand_name", "A", None), ("brand_name", "B", 2), ("net_contents", "C", 3)))], key=str)
    assert "Join" not in told._jdf.queryExecution().executedPlan().toString()
    assert reconcile.scripted_evidence(asked, script.limit(0)).collect() == []
    monkeypatch.setattr(reconcile, "SCRIPT_ROWS", 2)
    with pytest.raises(ValueError):
        reconcile.scripted_evidence(asked, script)
