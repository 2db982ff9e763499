"""Sequences of answers merged into fields, against a plain merge one answer after another."""

import random
import re

from pyspark.sql import functions as F

from proofmark.operators import diagnose, evidence, extract, reconcile, rules
from proofmark.operators.stages import Stages

R = random.Random(8)
NAMES = ["Stone Creek", "STONE CREEK", "Stone Creek Distillery", "di Stone Creek", "Oak Hill", "OAK", "Stone", "Creek Oak Hill Reserve", "", None, "Ñandú Été", "  "]
CLASSES = ["Bourbon Whiskey", "di BOURBON WHISKEY", "Vodka", "Straight Bourbon Whiskey", "Rum", None]
ALCOHOL = ["45% Alc./Vol.", "45% ABV", "90 Proof", "45% Alc./Vol. (90 PROOF)", "40% Alc./Vol.", "45.3% ABV", "(80 PROOF) 40% ABV", "strong", None, ""]
NET = ["750 mL", "0.75 L", "750ML", "1 L", "375 ml", "a bottle", None]
WARNING = ["GOVERNMENT WARNING: (1) According to the Surgeon General", "Government Warning", "nothing", None]
VALUES = dict(zip(("brand_name", "class_type", "alcohol_content", "net_contents", "government_warning"), (NAMES, CLASSES, ALCOHOL, NET, WARNING)))
NUMBER = r"(\d{1,2}(?:\.\d+)?)"


def key(t):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9'\s]", " ", (t or "").casefold())).strip()


def agree(a, b):
    a, b = key(a), key(b)
    if not a or not b:
        return False
    mine, other = [w for w in a.split() if len(w) > 3], [w for w in b.split() if len(w) > 3]
    return a in b or b in a or bool(mine) and all(any(u.startswith(w) or w.startswith(u) for u in other) for w in mine)


def prefer(a, b):
    if not a or not b:
        return a or b
    if not agree(a, b):
        return a
    x, y = key(a), key(b)
    sig = lambda t: [w for w in t.split() if len(w) > 3]

    def noise(longer, shorter):
        extra = [w for w in longer.split() if w not in shorter.split()]
        return len(sig(longer)) <= len(sig(shorter)) and bool(extra) and all(len(w) < 4 for w in extra)

    if x in y and len(y) > len(x) + 1:
        return a if noise(y, x) else b
    if y in x and len(x) > len(y) + 1:
        return b if noise(x, y) else a
    if len(sig(x)) != len(sig(y)):
        return b if len(sig(y)) > len(sig(x)) else a
    return a if len(a.strip()) <= len(b.strip()) else b


def alcohol(t):
    a, p = re.search(rf"({NUMBER}\s*%\s*(?:Alc\./Vol|ABV))", t or ""), re.search(r"\(?\s*(\d+)\s*proof\s*\)?", t or "", re.I)
    if not a and not p:
        return None
    proof = float(p[1]) if p else None
    return {"abv": float(a[2]) if a else proof / 2, "proof": proof, "source": "both" if a and p else "abv" if a else "proof", "span": a[1] if a else None}


def shown(a):
    g = lambda x: f"{x:g}"
    return f"{g(a['abv'])}% Alc./Vol." + (f" (proof={g(a['proof'])})" if a["proof"] is not None else "")


def net(t):
    m = re.search(r"(\d+(?:\.\d+)?)\s*(ml|l)\b", t or "", re.I)
    return m and (float(m[1]), "mL" if m[2].lower() == "ml" else "L")


def ml(n):
    return n and n[0] * (1000 if n[1] == "L" else 1)


def reinforced(s, said, name):
    ocr = (s["raw"] or s["value"] or "").strip()
    if not ocr or not said:
        return False
    if name == "alcohol_content":
        left, right = alcohol(ocr), alcohol(said)
        if not left or not right:
            return False
        if left["source"] == "proof" and right["source"] != "proof":
            return not (right["proof"] is not None and abs(right["proof"] - left["proof"]) > 0.6) and abs(right["abv"] - left["proof"] / 2) <= 0.6
        return abs(left["abv"] - right["abv"]) <= 0.5
    if name == "net_contents":
        left, right = net(ocr) or net(s["value"]), net(said)
        return bool(left and right) and abs(ml(left) - ml(right)) <= 0.5
    return agree(ocr, said)


def contradicted(s, said, name):
    if reinforced(s, said, name):
        return False
    if name == "alcohol_content":
        left, right = alcohol(s["raw"] or s["value"]), alcohol(said)
        return bool(left and right) and abs(left["abv"] - right["abv"]) > 0.5
    if name == "net_contents":
        left, right = net(s["value"] or s["raw"]), net(said)
        return bool(left and right) and abs(ml(left) - ml(right)) > 0.5
    ocr = s["raw"] or s["value"]
    return bool(key(ocr) and key(said)) and not agree(ocr, said)


def refused(name, value, observed, sure, unable):
    said = (value or observed or "").strip()
    if unable:
        return "unable_to_determine"
    if not value and not observed:
        return "empty_candidate"
    if sure in ("LOW", None):
        return "low_confidence"
    if not said:
        return "empty_text"
    if name == "alcohol_content" and (not alcohol(said) or alcohol(said)["source"] == "proof"):
        return "abv_unparseable"
    if name == "net_contents" and not net(said):
        return "net_contents_unparseable"
    return None


def merged(name, s, told):
    s, outcomes, conflicts = dict(s, seen=list(s["seen"])), [], []
    for value, observed, sure, unable in told:
        bad, said = refused(name, value, observed, sure, unable), (value or observed or "").strip()
        near = not bad and reinforced(s, said, name)
        far = not bad and contradicted(s, said, name)
        if bad:
            outcomes.append(f"rejected:{bad}")
            continue
        if s["status"] == "FOUND":
            outcome = "supplemented" if near else "conflict" if far else "kept_ocr"
        else:
            outcome = "conflict" if s["raw"] and s["status"] == "UNCERTAIN" and far else "filled"
        outcomes.append(outcome)
        if outcome == "kept_ocr":
            continue
        seen = list(dict.fromkeys([*s["seen"], s["raw"] or "", said]))
        if outcome == "conflict":
            conflicts.append((s["raw"], said))
            s |= {"status": "UNCERTAIN", "seen": seen, "reason": "CONFLICTING_EVIDENCE"}
            continue
        new = {"raw": said, "value": said, "seen": seen, "status": "FOUND" if outcome == "supplemented" or sure == "HIGH" or sure == "MEDIUM" and near else "UNCERTAIN"}
        if name == "alcohol_content":
            a = alcohol(said)
            new |= {"value": shown(a), "number": a["abv"], "unit": "%", "source": a["source"]}
            if outcome == "supplemented" and a["source"] == "abv":
                new["raw"] = a["span"]
        elif name == "net_contents":
            n = net(said)
            new |= {"value": f"{n[0]:g} {n[1]}", "number": n[0], "unit": n[1]}
            if outcome == "supplemented":
                new["raw"] = s["raw"] or said
        elif name == "government_warning":
            new["value"] = "GOVERNMENT WARNING"
        else:
            new |= {"value": prefer(s["value"] or s["raw"], said), "raw": prefer(s["raw"], said)}
        s |= new
    return s, outcomes, conflicts


FIELD_DDL = "item_id long, field_name string, status string, raw_text string, normalized_value string, normalized_numeric double, normalized_unit string, candidates array<string>, reason string, source string, extra int"
ANSWER_DDL = "item_id long, field_name string, at int, candidate_value string, raw_observed_text string, confidence string, unable_to_determine boolean"


def made():
    fields, told = [], []
    for i in range(700):
        for name, values in VALUES.items():
            status = R.choice(["FOUND", "UNCERTAIN", "NOT_FOUND"])
            raw = None if status == "NOT_FOUND" else R.choice(values)
            value = R.choice([raw, raw, None])
            fields.append((i, name, status, raw, value, None, None, [raw] if raw else [], R.choice([None, "brand_ambiguous"]), None, 1))
            for at in range(R.choice([0, 1, 2, 3, 3, 4])):
                pick = R.choice(values)
                told.append((i, name, at, pick, R.choice([None, R.choice(values)]), R.choice(["HIGH", "HIGH", "MEDIUM", "LOW", None]), R.random() < 0.05))
    told += [(10_000, "brand_name", 0, "Oak Hill", None, "HIGH", False), (10_000, "brand_name", 1, "Oak Hill", None, "LOW", None), (3, "no_such_field", 0, "x", None, "HIGH", False)]
    return fields, told


def test_sequences_of_answers_equal_a_plain_merge(spark):
    fields, told = made()
    shuffled = R.sample(told, len(told))
    out = evidence.merge(spark.createDataFrame(fields, FIELD_DDL), spark.createDataFrame(shuffled, ANSWER_DDL)).collect()
    assert len(out) == len(fields) + 2
    by = {(r.item_id, r.field_name): r for r in out}
    kinds = set()
    for i, name, status, raw, value, number, unit, seen, reason, source, _ in fields:
        s = {"status": status, "raw": raw, "value": value, "number": number, "unit": unit, "seen": seen, "reason": reason, "source": source}
        s, outcomes, conflicts = merged(name, s, [t[3:] for t in told if t[:2] == (i, name)])
        r = by[i, name]
        got = {"status": r.status, "raw": r.raw_text, "value": r.normalized_value, "number": r.normalized_numeric, "unit": r.normalized_unit, "seen": list(r.candidates), "reason": r.reason, "source": r.source}
        assert (got, list(r.outcomes), [tuple(x) for x in r.conflicts]) == (s, outcomes, conflicts), (name, status, raw, value, [t for t in told if t[:2] == (i, name)])
        assert r.outcome == (outcomes[-1] if outcomes else None) and r.updated == any(o in evidence.CHANGING for o in outcomes)
        kinds |= set(outcomes)
    assert kinds >= {"supplemented", "filled", "conflict", "kept_ocr"} and len(kinds) >= 8
    assert list(by[10_000, "brand_name"].outcomes) == ["rejected:unknown_field", "rejected:low_confidence"] and not by[3, "no_such_field"].updated


def test_outcomes_come_by_item_and_mark_what_changed(spark):
    outcomes = [(1, "brand_name", ["rejected:low_confidence"], False), (1, "net_contents", ["filled", "kept_ocr"], True), (2, "alcohol_content", ["conflict"], True), (3, "class_type", [], False)]
    m = spark.createDataFrame(outcomes, "item_id long, field_name string, outcomes array<string>, updated boolean").withColumn("outcome", F.when(F.size("outcomes") > 0, F.element_at("outcomes", -1)))
    got = {r.item_id: (list(r.fields_updated), r.merge_outcomes, r.conflicted) for r in evidence.by_item(m).collect()}
    assert got == {1: (["net_contents"], {"brand_name": "rejected:low_confidence", "net_contents": "kept_ocr"}, False), 2: (["alcohol_content"], {"alcohol_content": "conflict"}, True)}
    state = "item_id long, status_before string, eligible boolean, configured boolean, available boolean, called boolean, answered boolean, raised boolean, method string"
    yes, no = True, False
    items = spark.createDataFrame([(1, "REVIEW", yes, yes, yes, yes, yes, no, "ocr_only"), (2, "REVIEW", yes, yes, yes, yes, yes, no, "ocr_only"), (3, "REVIEW", yes, yes, yes, yes, yes, no, "ocr_plus_enhanced"), (4, "REVIEW", yes, yes, no, no, no, no, "ocr_only"), (5, "REVIEW", yes, yes, yes, yes, no, no, "ocr_only"), (6, "REVIEW", yes, yes, yes, no, no, no, "ocr_only"), (7, "REVIEW", yes, yes, yes, yes, yes, yes, "ocr_only"), (8, "REVIEW", None, yes, yes, no, no, no, "ocr_only"), (9, "PASS", None, yes, yes, no, no, no, "ocr_only"), (10, "FAIL", None, yes, yes, no, no, no, "ocr_only")], state)
    told = evidence.assistance(items, m)
    assert {r.item_id: (r.evidence_method, r.outcome, r.failure_category) for r in told.collect()} == {
        1: ("ocr_plus_ai", "evidence_merged", None), 2: ("ocr_plus_ai_conflict", "evidence_merged", None), 3: ("ocr_plus_enhanced_ai_rejected", "no_usable_evidence", "no_usable_evidence"), 4: ("ocr_only_ai_unavailable", "provider_unavailable", "provider_unavailable"),
        5: ("ocr_only_ai_failed", "provider_failed", "provider_failed"), 6: ("ocr_only_ai_unavailable", "provider_not_called", "not_called"), 7: ("ocr_only_ai_failed", "provider_exception", "provider_exception"), 8: ("ocr_only", "not_eligible", None), 9: ("ocr_only", "not_needed_pass", None), 10: ("ocr_only", "not_needed_fail", None),
    }
    checks = rules.stub(spark.createDataFrame([(1,), (4,), (99,)], "item_id long")).withColumn("explanation", F.lit("why"))
    marked = {(r.item_id, r.check_name): r for r in rules.annotate(checks, told).collect()}
    assert marked[1, "Net Contents"].ai_assisted_evidence and marked[1, "Net Contents"].ai_merge_outcome == "kept_ocr" and marked[1, "Net Contents"].explanation == "why" + rules.CONSIDERED
    assert marked[1, "Brand Name"].ai_assisted_evidence is None and marked[1, "Brand Name"].explanation == "why"
    assert marked[4, "Brand Name"].ai_failure_category == "provider_unavailable" and marked[99, "Brand Name"].evidence_method is None


CHECK_DDL = "item_id long, check_name string, status string, reason_code string, underlying_reason_code string, ai_assist_eligible boolean, detected_value string, app_value string, quality string, extracted struct<status:string,raw_text:string,candidates:array<string>,reason:string>"


def test_requests_are_whole_packages_of_items_under_review(spark):
    x = ("UNCERTAIN", "raw", ["a", "b"], "why")
    rows = [
        (1, "Net Contents", "REVIEW", "EXTRACTION_UNCERTAIN", None, True, "seen", "750 mL", "POOR", x),
        (1, "Brand Name", "REVIEW", "OCR_LOW_QUALITY", "EXTRACTION_UNCERTAIN", False, "seen", "Oak", "POOR", x),
        (1, "Class / Type", "REVIEW", "OCR_LOW_QUALITY", None, True, "seen", None, "POOR", None),
        (1, "Alcohol Content / ABV", "PASS", "ABV_MATCH", None, True, "seen", None, "POOR", x),
        (2, "Net Contents", "REVIEW", "EXTRACTION_UNCERTAIN", None, True, "seen", None, "GOOD", x),
        (2, "Brand Name", "FAIL", "BRAND_MISMATCH", None, False, "seen", None, "GOOD", x),
        (3, "Government Health Warning", "REVIEW", "WARNING_CAPS_REVIEW", None, True, "seen", None, "GOOD", x),
        (4, "Brand Name", "REVIEW", "BRAND_AMBIGUOUS", None, True, "seen", None, "GOOD", None),
        (4, "Other", "REVIEW", "BRAND_AMBIGUOUS", None, True, "seen", None, "GOOD", x),
        (5, "Brand Name", "REVIEW", "BRAND_AMBIGUOUS", None, False, "seen", None, "GOOD", x),
        (6, "Government Health Warning", "REVIEW", "OCR_LOW_QUALITY", None, False, "seen", None, "GOOD", ("NOT_FOUND", None, None, None)),
    ]
    got = {r.item_id: (r.quality, [tuple(f) for f in r.fields]) for r in reconcile.requests(spark.createDataFrame(rows, CHECK_DDL)).collect()}
    task = reconcile.TASKS
    assert got == {
        1: ("POOR", [("brand_name", "EXTRACTION_UNCERTAIN", task["brand_name"], "raw", ["a", "b"], "Oak", "UNCERTAIN", "why"), ("net_contents", "EXTRACTION_UNCERTAIN", task["net_contents"], "raw", ["a", "b"], "750 mL", "UNCERTAIN", "why")]),
        4: ("GOOD", [("brand_name", "BRAND_AMBIGUOUS", task["brand_name"], "seen", [], None, None, None)]),
        6: ("GOOD", [("government_warning", "WARNING_MISSING", task["government_warning"], None, [], None, "NOT_FOUND", None)]),
    }


def test_stages_are_timed_counted_and_deleted(spark, tmp_path):
    with Stages(spark, f"file://{tmp_path}") as run:
        one = run.store("one", spark.range(1000).withColumn("x", F.col("id") % 7), highest=F.max("x"), total=F.sum("id"))
        two = run.store("two", one.where("x = 3"), keep=True)
        assert two.count() == 143 and len(list(tmp_path.glob("run-*/one"))) == 1
        rows = run.timings().collect()
        try:
            run.store("one", two)
            raise AssertionError("a name is taken once")
        except ValueError:
            pass
    assert [(r.place, r.stage, r.n_rows, r.metrics) for r in rows] == [(0, "one", 1000, {"highest": 6.0, "total": 499500.0}), (1, "two", 143, {})]
    assert all(r.elapsed_ms > 0 for r in rows) and run.overall_ms() == sum(r.elapsed_ms for r in rows)
    assert list(tmp_path.glob("run-*/one")) == [] and two.count() == 143
    with Stages(spark, f"file://{tmp_path}") as empty:
        assert empty.store("none", spark.range(0)).count() == 0
        assert empty.timings().first().n_rows == 0


def test_a_filter_stays_out_of_extraction(spark):
    """What made requests impossible to plan: a later filter pushed through the expressions of extraction."""
    lines = spark.range(3).select(F.col("id").alias("item_id"), F.lit("OLD OAK\nVodka\n40% Alc./Vol.").alias("full_text"), F.array().cast(extract.WORDS).alias("words"), F.lit(800).alias("image_width_px"), F.lit(600).alias("image_height_px"))
    with Stages(spark) as run:
        fields = run.store("fields", extract.fields(lines))
        plan = fields.where("status = 'FOUND'")._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and fields.where("status = 'FOUND'").count() == 9


def test_losses_name_the_first_stage_that_lost_a_value(spark):
    ddl = "item_id long, field_name string, status string, raw_text string, normalized_value string"
    stage = lambda *rows: spark.createDataFrame([(i, "brand_name", *r) for i, *r in rows], ddl)
    stages = {
        "fast": stage((1, "FOUND", "A", "a"), (2, "FOUND", "A", "a"), (3, "NOT_FOUND", None, None), (4, "UNCERTAIN", "A", None), (5, "NOT_FOUND", "x", None), (6, "FOUND", " ", ""), (7, "FOUND", "A", "a")),
        "region": stage((1, "FOUND", "A", "A"), (2, "NOT_FOUND", None, None), (4, "FOUND", "B", "b")),
        "answered": stage((1, "FOUND", "A", "a"), (2, "FOUND", "A", "a"), (3, "FOUND", "C", None), (4, "NOT_FOUND", None, None), (5, "NOT_FOUND", None, None), (6, "NOT_FOUND", None, None)),
    }
    rules_ = spark.createDataFrame([(1, "brand_name", "PASS", "BRAND_MATCH")], "item_id long, field_name string, status string, reason_code string")
    lost = diagnose.losses(stages, rules_)
    got = {r.item_id: (r.first_at, r.lost_at, r.lost, r.regained_at, r.changed_at, r.last_shown, r.outcome, r.rule_reason) for r in lost.collect()}
    assert got == {
        1: ("fast", None, None, None, None, "a", "kept", "BRAND_MATCH"),
        2: ("fast", "region", "a", "answered", None, "a", "regained", None),
        3: ("answered", None, None, None, None, "C", "late", None),
        4: ("fast", "answered", "b", None, "region", "b", "lost", None),
        5: (None, None, None, None, None, None, "never", None),
        6: (None, None, None, None, None, None, "never", None),
        7: ("fast", None, None, None, None, "a", "kept", None),
    }
    assert {(r.outcome, r.lost_at): r.n for r in diagnose.by_stage(lost).collect()}[("kept", None)] == 2
    assert [x.stage for x in lost.where("item_id = 3").first().states] == ["fast", "answered"]
