"""Label verification: golden examples of parsing, extraction, rules, reconciliation, manifests and exports."""

import math

import pytest
from pyspark.sql import functions as F

from proofmark.config import CHECKS, FIELDS, MANIFEST_COLUMNS, STATUTORY_WARNING
from proofmark.functions import parse, similarity, text
from proofmark.operators import evaluate, exports, extract, images, manifest, reconcile, rules, summary
from proofmark.sources import providers, readers
from proofmark.streaming import lifecycle

c = F.col


def values(spark, inputs, expression):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in rows.select("i", expression(c("x")).alias("v")).orderBy("i").collect()]


def test_normalisation_and_its_quirks(spark):
    got = values(spark, ["Stone’s Throw", "STONE'S  throw", "O`Hara", "Café", None, "  ", "Straße"], text.comparison_normalize)
    assert got == ["stone s throw", "stone's throw", "o'hara", "caf", None, None, "strasse"]
    assert values(spark, ["45% Alc./Vol."], text.eval_normalize) == ["45% alc./vol."]
    assert values(spark, ["a\r\n b \n\n\tc"], text.lines) == [["a", "b", "c"]]


def test_file_names(spark):
    assert values(spark, ["../etc/passwd", "folder/label.jpg", " a-1.jpg ", "a.jpg\n", "", None, "x..y", "ü.png"], text.safe_filename) == [None, None, "a-1.jpg", "a.jpg", None, None, None, None]
    assert values(spark, ["a.JPG", ".jpg", "a", "a.b.png"], text.extension) == [".jpg", "", "", ".png"]


def test_number_format_is_that_of_c(spark):
    numbers = [45.0, 2.25, 0.5, 100.0, 1234567.0, 0.0, 13.30, 123.456789, 0.00001]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = df.select("i", text.general(c("x")).alias("g"), text.fixed(c("x")).alias("f")).orderBy("i").collect()
    assert [r.g for r in got] == [f"{x:g}" for x in numbers]
    assert [r.f for r in got][:4] == ["45.0", "2.2", "0.5", "100.0"]


@pytest.mark.parametrize(
    "line, abv, proof, source",
    [
        ("45% Alc./Vol.", 45.0, None, "abv"),
        ("45 % ALC/VOL", 45.0, None, "abv"),
        ("ALC. 45% BY VOL.", 45.0, None, "abv"),
        ("45% ABV", 45.0, None, "abv"),
        ("90 Proof", 45.0, 90.0, "proof"),
        ("45% Alc./Vol. 90 Proof", 45.0, 90.0, "both"),
        ("145% alc/vol", 45.0, None, "abv"),
        ("no statement", None, None, None),
    ],
)
def test_alcohol(spark, line, abv, proof, source):
    a = values(spark, [line], parse.alcohol)[0]
    assert (a and (a.abv, a.proof, a.source)) == (source and (abv, proof, source))


def test_net_contents(spark):
    got = values(spark, ["750 mL", "750ML", "1.75 L", "2 liters", "none"], parse.net)
    assert [g and (g.value, g.unit) for g in got] == [(750, "mL"), (750, "mL"), (1.75, "L"), (2, "L"), None]
    sure = lambda x: parse.net_reliable(x, parse.net(x)["span"])
    assert values(spark, ["(90 PROOF) 750 mL", "ge | 750mL", "Net Contents: 750 mL"], sure) == [True, False, True]
    assert values(spark, ["45%", "45", "750 mL", "none"], parse.application_abv) == [45.0, 45.0, 75.0, None]
    assert values(spark, ["750 mL", "0.75 L"], parse.application_net_ml) == [750.0, 750.0]
    assert values(spark, ["90 Proof", "45% ABV", "45% Alc./Vol.", None], parse.authorized_abv) == [False, True, True, False]


def test_similarity_goldens(spark):
    assert round(similarity.indel("kitten", "sitting"), 3) == 61.538
    assert similarity.token_sort("Bourbon Whiskey".lower(), "kentucky straight bourbon whiskey") == 62.5
    assert similarity.token_set("a b c", "b a c d") == 100.0 and similarity.token_set("", "a") == 0.0
    assert similarity.partial("45", "alcohol 45 percent") == 100.0 and similarity.partial("", "x") == 0.0
    df = spark.createDataFrame([("abc", "axc"), ("abc", "abc"), ("", ""), ("", "a")], "a string, b string")
    assert [r.v for r in df.select(similarity.character_error_rate(c("a"), c("b")).alias("v")).collect()] == [1 / 3, 0.0, 0.0, 1.0]


LABEL = f"OLD TOM DISTILLERY\nKentucky Straight Bourbon Whiskey\n45% Alc./Vol.\n750 mL\n{STATUTORY_WARNING}"


def record(spark, rows):
    return spark.createDataFrame(rows, f"item_id string, full_text string, words {extract.WORDS}, image_width_px int, image_height_px int")


def test_fields_of_a_whole_label(spark):
    got = {r.field_name: r for r in extract.fields(record(spark, [("a", LABEL, None, 800, 600)])).collect()}
    assert [got[f].status for f in FIELDS] == ["FOUND"] * 5
    assert got["brand_name"].raw_text == "OLD TOM DISTILLERY" and got["alcohol_content"].normalized_numeric == 45.0 and got["net_contents"].normalized_value == "750 mL"
    missing = {r.field_name: r.status for r in extract.fields(record(spark, [("b", None, None, None, None), ("c", "", [], 1, 1)])).collect()}
    assert set(missing.values()) == {"NOT_FOUND"}


def box(t, x0, y0, x1, y1, conf=0.9):
    return (t, conf, (float(x0), float(y0), float(x1), float(y1)))


@pytest.mark.parametrize(
    "lines, words, status, brand",
    [
        ("RIVER BEND\nDISTILLERY", [box("RIVER", 80, 20, 200, 70), box("BEND", 210, 20, 320, 70), box("DISTILLERY", 100, 90, 280, 120)], "FOUND", "RIVER BEND"),
        ("IRON RIDGE\nDISTILLING CO.", [box("IRON", 50, 10, 140, 60), box("RIDGE", 150, 10, 260, 60), box("DISTILLING", 80, 95, 220, 125), box("CO.", 225, 95, 270, 125)], "FOUND", "IRON RIDGE"),
        ("APPLE CREEK", [box("APPLE", 1, 20, 110, 70, 0.28), box("CREEK", 120, 20, 240, 70)], "UNCERTAIN", "APPLE CREEK"),
        ("hispering =", [box("hispering", 40, 20, 180, 60, 0.7), box("=", 185, 25, 200, 55, 0.4)], "UNCERTAIN", None),
        ("APLE CREEK", [box("M", 20, 22, 35, 68, 0.6), box("APLE", 40, 20, 130, 70), box("CREEK", 140, 20, 250, 70)], "UNCERTAIN", "APLE CREEK"),
    ],
)
def test_brand_geometry(spark, lines, words, status, brand):
    f = record(spark, [("a", lines, words, 800, 600)]).select(extract.brand(c("full_text"), c("words"), c("image_width_px"), c("image_height_px")).alias("f")).first().f
    assert f.status == status and (brand is None or f.raw_text == brand)


def verdicts(spark, rule, cases, quality="GOOD"):
    rows = [(i, app, *f) for i, (app, *f) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, app string, status string, raw string, value string, number double, unit string, source string, reason string")
    df = df.withColumn("f", F.explode(F.array(extract.field(c("status"), c("raw"), c("value"), c("number"), c("unit"), reason=c("reason"), source=c("source")))))
    done = df.select("i", rule(c("app"), c("f"), F.lit(quality)).alias("r")).orderBy("i").collect()
    return [(r.r.status, r.r.reason_code) for r in done]


def test_brand_and_class_rules(spark):
    f = lambda v, status="FOUND", reason=None: (status, v, v, None, None, None, reason)
    app = "Stone's Throw"
    assert verdicts(spark, rules.brand, [(app, *f("STONE'S THROW")), (app, *f("NORTH PEAK DISTILLING")), (app, *f("STONE?", "UNCERTAIN")), (app, *f("x", "UNCERTAIN", "brand_ambiguous")), (app, *f("Stone's Thrown"))]) == [
        ("PASS", "BRAND_MATCH"), ("FAIL", "BRAND_MISMATCH"), ("REVIEW", "EXTRACTION_UNCERTAIN"), ("REVIEW", "BRAND_AMBIGUOUS"), ("PASS", "BRAND_MATCH"),
    ]
    assert verdicts(spark, rules.brand, [(app, *f("STONE?", "UNCERTAIN")), (app, *f(None, "NOT_FOUND"))], "POOR") == [("REVIEW", "OCR_LOW_QUALITY")] * 2
    app = "Straight Bourbon Whiskey"
    assert verdicts(spark, rules.class_type, [(app, *f(app.upper())), (app, *f("Vodka")), ("Bourbon Whiskey", *f("Kentucky Straight Bourbon Whiskey"))]) == [("PASS", "CLASS_TYPE_MATCH"), ("FAIL", "CLASS_TYPE_MISMATCH"), ("REVIEW", "CLASS_TYPE_AMBIGUOUS")]


def test_quantity_rules(spark):
    a = lambda raw, n, source="abv": ("FOUND", raw, raw, n, "%", source, None)
    assert verdicts(spark, rules.alcohol, [("45%", *a("45% Alc./Vol.", 45.0)), ("45%", *a("40% Alc./Vol.", 40.0)), ("45%", *a("90 Proof", 45.0, "proof")), ("none", *a("45% ABV", 45.0))]) == [
        ("PASS", "ABV_MATCH"), ("FAIL", "ABV_MISMATCH"), ("REVIEW", "PROOF_ONLY_NO_PERCENT_STATEMENT"), ("REVIEW", "APPLICATION_VALUE_INVALID"),
    ]
    n = lambda v, x, u: ("FOUND", v, v, x, u, None, None)
    assert [s for s, _ in verdicts(spark, rules.net, [("750 mL", *n("0.75 L", 0.75, "L")), ("750 mL", *n("1 L", 1.0, "L"))])] == ["PASS", "FAIL"]


def test_warning_rule(spark):
    w = lambda raw, status="FOUND": (status, raw, "GOVERNMENT WARNING", None, None, None, None)
    mixed = STATUTORY_WARNING.replace("GOVERNMENT WARNING", "Government Warning")
    got = verdicts(spark, rules.warning, [(None, *w(STATUTORY_WARNING)), (None, *w(None, "NOT_FOUND")), (None, *w("GOVERNMENT", "UNCERTAIN")), (None, *w(mixed)), (None, *w(STATUTORY_WARNING.lower())), (None, *w("GOVERNMENT WARNING: entirely other words stand here"))])
    assert got[:5] == [("PASS", "WARNING_WORDING_MATCH"), ("REVIEW", "WARNING_MISSING"), ("REVIEW", "WARNING_PARTIAL"), ("REVIEW", "WARNING_CAPS_REVIEW"), ("REVIEW", "WARNING_CAPS_REVIEW")]
    assert got[5][0] in ("FAIL", "REVIEW")


def test_checks_and_summary(spark):
    f = extract.fields(record(spark, [("a", LABEL, None, 800, 600), ("b", "", None, 800, 600)])).withColumns({"quality": F.lit("GOOD"), "app_value": F.when(c("field_name") == "brand_name", "Old Tom Distillery").when(c("field_name") == "class_type", "Kentucky Straight Bourbon Whiskey").when(c("field_name") == "alcohol_content", "45%").when(c("field_name") == "net_contents", "750 mL")})
    done = rules.run(f)
    per = {r.item_id: r for r in summary.items(done, "item_id").collect()}
    assert per["a"].overall_status == "PASS" and per["a"].pass_count == 5 and per["b"].overall_status == "REVIEW" and per["b"].review_count == 5
    assert per["b"].review_reason_codes.split(";")[-1] == "WARNING_MISSING"
    pivot = {r.item_id: r for r in exports.check_statuses(done).collect()}
    assert pivot["a"].government_warning_status == "PASS" and len(CHECKS) == 5


def batch(spark, rows, names):
    m = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "row_number int, " + ", ".join(f"{x} string" for x in MANIFEST_COLUMNS))
    u = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "filename string, ordinal int")
    return manifest.validate(m, u).first(), {r.code for r in manifest.issues(m, u).collect()}


def test_manifest_validation(spark):
    row = lambda name: (name, "B", "Vodka", "40%", "750 mL")
    ok, codes = batch(spark, [row("a.jpg")], ["a.jpg"])
    assert ok.valid and ok.matched_count == 1 and not codes
    assert "duplicate_filename" in batch(spark, [row("a.jpg"), row("a.jpg")], ["a.jpg"])[1]
    assert "missing_image" in batch(spark, [row("a.jpg")], ["b.jpg"])[1]
    extra, codes = batch(spark, [row("a.jpg")], ["a.jpg", "extra.jpg"])
    assert extra.valid and extra.unreferenced_count == 1 and codes == {"unreferenced_image"}
    assert "unsupported_image" in batch(spark, [row("a.gif")], ["a.gif"])[1]
    twice, codes = batch(spark, [row("a.jpg")], ["a.jpg", "a.jpg"])
    assert not twice.valid and codes == {"duplicate_image", "missing_image"}
    bad, codes = batch(spark, [("a.jpg", " ", "Vodka", "40%", "750 mL")], ["a.jpg"])
    assert codes == {"invalid_application_values", "unreferenced_image"} and bad.missing_count == 1


def test_manifest_reader(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_bytes('﻿ Filename ,brand_name,class_type,alcohol_content,net_contents\n a.jpg ,"Two\nlines ""x""",Vodka,40%,\n'.encode())
    rows, problem = readers.manifest(spark, str(good))
    assert problem is None and [tuple(r) for r in rows.collect()] == [("a.jpg", 'Two\nlines "x"', "Vodka", "40%", "", 2)]
    for content, code in ((b"", "empty_manifest"), (b"filename\xff\xfe,x\n", "manifest_encoding"), (b"filename,brand_name\na,b\n", "missing_columns"), (",".join(MANIFEST_COLUMNS).encode() + b"\n", "empty_manifest")):
        path = tmp_path / "x.csv"
        path.write_bytes(content)
        assert readers.manifest(spark, str(path))[1] == code


def test_pass_choice_and_merge(spark):
    rows = [("a", "fast", "FOUND"), ("a", "fast", "NOT_FOUND"), ("a", "enhanced", "UNCERTAIN"), ("a", "enhanced", "UNCERTAIN"), ("b", "fast", "FOUND"), ("b", "enhanced", "FOUND")]
    chosen = reconcile.select_pass(reconcile.pass_scores(spark.createDataFrame(rows, "item_id string, profile string, status string"), "item_id", "profile"))
    assert dict(chosen.select("item_id", "selected_profile").collect()) == {"a": "enhanced", "b": "fast"}


def test_brand_reconciliation_table(spark):
    cases = [
        ("FOUND", "A B", "NOT_FOUND", None, False, "no_text"), ("FOUND", "A B", "UNCERTAIN", "X", False, "uncertain_kept_base"), ("FOUND", "A B", "UNCERTAIN", "X", True, "conflict_uncertain"),
        ("UNCERTAIN", "A", "FOUND", "X", False, "partial_uncertain"), ("NOT_FOUND", None, "FOUND", "X", False, "replaced_weaker_base"), ("NOT_FOUND", None, "UNCERTAIN", "X", False, "filled_empty_base"),
        ("UNCERTAIN", "x", "UNCERTAIN", "X", False, "reinforced_uncertain"), ("FOUND", "a b", "FOUND", "A B", False, "reinforced"), ("FOUND", "PLE CREEK", "FOUND", "MAPLE CREEK", True, "superseded_weaker"), ("FOUND", "A B", "FOUND", "X Y", False, "conflict_uncertain"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, bs string, bv string, cs string, cv string, s boolean, want string")
    side = lambda p: F.struct(c(f"{p}s").alias("status"), c(f"{p}v").alias("value"))
    assert [r.o == r.want for r in df.select("i", "want", reconcile.reconcile_brand(side("b"), side("c"), c("s"), F.lit(0))["outcome"].alias("o")).orderBy("i").collect()] == [True] * len(cases)


def test_budget_and_filters(spark):
    df = spark.createDataFrame([(i,) for i in range(9)], "item_id int")
    assert sorted(r.item_id for r in reconcile.within_budget(df, 4).where("granted").collect()) == [0, 1, 2, 3]
    times = spark.createDataFrame([(5.0,), (1.0,), (3.0,), (3.0,), (9.0,), (None,)], "x double")
    assert summary.nearest_rank(times, "x", 0.95).first().p == 9.0 and summary.nearest_rank(times, "x", 0.5).first().p == 3.0


def test_images(spark):
    q = images.quality(c("side"), c("blur"), F.lit(120.0), F.lit(40.0), F.lit(0.0), F.lit(0.0))
    rows = spark.createDataFrame([(900, 300.0), (300, 300.0), (900, 10.0)], "side int, blur double").select(q.alias("q")).collect()
    assert [r.q.status for r in rows] == ["GOOD", "WARNING", "POOR"] and rows[2].q.warnings == ["blur"]
    import numpy as np

    flat = providers.measure(np.full((5, 5), 100, np.uint8))
    assert flat["laplacian_variance"] == 0.0 and flat["mean_brightness"] == 100.0
    images_ = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b""))], "item_id string, content binary")
    providers.register("size", lambda: lambda b: {"full_text": str(1 // len(b))})
    assert {r.item_id: (r.full_text, r.error and r.error[:5]) for r in providers.recognise(images_, providers.provider("size")).collect()} == {"a": ("1", None), "b": (None, "ZeroD")}
    with pytest.raises(ValueError):
        providers.provider("unknown")


def test_exports(spark, tmp_path):
    assert values(spark, ["=CMD()", "normal", None, "\tx", "'=CMD()"], exports.safe_cell) == ["'=CMD()", "normal", "", "'\tx", "'=CMD()"]
    assert values(spark, ["a\n b"], lambda x: exports.audit(F.lit("e"), x, n=F.lit(None))) == ['{"event":"e","message":"a b"}']


def test_leaderboard_percentile_is_linear(spark):
    t = spark.createDataFrame([("e", "fast", 1, True, None, 3, None, float(x), True) for x in (1, 2, 3, 10)], "provider string, profile string, edge int, success boolean, failure_kind string, fields_recovered int, cer double, total_ms double, has_boxes boolean")
    r = evaluate.leaderboard(t, "provider").first()
    assert r.median_ms == 2.5 and math.isclose(r.p95_ms, 8.95) and r.mean_cer == 1.0


def test_live_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"item_id":"a","profile":"fast","errors":[]}\n{"item_id":"b","profile":"fast","errors":["x"]}\n')
    lifecycle.run(spark, str(source), str(tmp_path / "items"), str(tmp_path / "ck")).awaitTermination(60)
    lifecycle.run(spark, str(source), str(tmp_path / "items"), str(tmp_path / "ck")).awaitTermination(60)
    assert {(r.item_id, r.processing_state) for r in spark.read.parquet(str(tmp_path / "items")).collect()} == {("a", "COMPLETED"), ("b", "ERROR")}


def test_decimals_are_those_of_c(spark):
    numbers = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 1.005, 2.675, 439117.45, 258433.55, 999.95, -0.04, -1.25, 123456789.05, 1e-9, 0.9999999, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    for places in (1, 2):
        got = {r.i: r.k for r in df.select("i", text.fixed(F.col("x"), places).alias("k")).collect()}
        assert got == {i: None if x is None else f"{x:.{places}f}" for i, x in enumerate(numbers)}


def test_agreement_of_names(spark):
    cases = [("OLD TOM", "Old Tom Distillery", True), ("Stone's Throw", "STONE`S THROW", True), ("River Bend", "Riverside Bending", True), ("the a", "of it", False), ("Maple Hill", "Pine Hill", False), ("MAPLE CREEK", "maple creek distilling", True), ("MAPLE", "", False), ("", "x", False), (None, "x", False), ("!!", "!!", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.k for r in df.select("i", similarity.candidates_agree(F.col("a"), F.col("b")).alias("k")).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(cases)}
    kept = [("OLD TOM", "OLD TOM DISTILLERY", "OLD TOM DISTILLERY"), ("OLD TOM", "OLD TOM ee", "OLD TOM"), ("OLD TOM ee", "OLD TOM", "OLD TOM"), ("Oak", "Pine", "Oak"), (None, "Oak", "Oak"), ("Oak", "", "Oak"), ("Oak.", "Oak", "Oak"), ("BOURBON WHISKEY", "di BOURBON WHISKEY", "BOURBON WHISKEY")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(kept)], "i int, a string, b string")
    got = {r.i: r.k for r in df.select("i", similarity.prefer_agreeing(F.col("a"), F.col("b")).alias("k")).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(kept)}


def test_budget_with_repeated_keys_and_worst_status(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "item_id int, x string")
    assert sorted(r.granted for r in reconcile.within_budget(df, 2).collect()) == [False, False, True, True]
    assert all(r.granted for r in reconcile.within_budget(df, 9).collect()) and not any(r.granted for r in reconcile.within_budget(df, 0).collect())
    checks = spark.createDataFrame([(1, CHECKS[0], "PASS"), (1, CHECKS[0], "FAIL"), (1, CHECKS[1], "REVIEW")], "item_id int, check_name string, status string")
    row = exports.check_statuses(checks).first()
    assert (row.brand_status, row.class_type_status, row.net_contents_status) == ("FAIL", "REVIEW", None)


def test_uploads_are_numbered_by_path(spark, tmp_path):
    for name in ("b.png", "a.png", "c.png"):
        (tmp_path / name).write_bytes(name.encode())
    assert {r.filename: r.ordinal for r in readers.uploads(spark, str(tmp_path)).collect()} == {"a.png": 1, "b.png": 2, "c.png": 3}


def test_evidence_providers_and_operations(spark):
    asked = spark.createDataFrame([(1, [("brand_name",)]), (2, [("class_type",)])], "item_id int, fields array<struct<field:string>>")
    script = spark.createDataFrame([("brand_name", "A")], "field_name string, candidate_value string")
    assert sorted(map(tuple, reconcile.scripted_evidence(asked, script).select("item_id", "candidate_value").collect())) == [(1, "A"), (2, "A")]
    assert [r.called for r in reconcile.no_evidence(asked, "off").collect()] == [False, False]
