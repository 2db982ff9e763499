"""Registered queries of whole verification runs: extraction, checks, requests, and exports that rest on them.

Extracted fields and checks are stored between stages (see ``operators.stages``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.config import EXPORT_COLUMNS
from proofmark.operators import diagnose, evaluate, evidence, exports, extract, jobs, reconcile, rules, summary
from proofmark.operators.stages import Stages
from proofmark.plans import oracle as o
from proofmark.plans import whole
from proofmark.plans.labels import ODD, labels, odd_labels
from proofmark.plans.queries import ITEMS, T, items, records, trials, two_passes
from proofmark.plans.registry import register
from proofmark.sources import readers
from proofmark.streaming import live

c, q = F.col, o.q


@register("ext_05_brand", f"{whole.FIELDS_SQL} SELECT item_id, status, raw_text, normalized_value, normalized_numeric, reason, array_to_string(candidates, '|') AS candidates FROM f WHERE field_at = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.brand(c("full_text"), c("words"), c("image_width_px"), c("image_height_px"))
    return records(spark, sf_dir).select("item_id", found.alias("f")).select("item_id", "f.status", "f.raw_text", "f.normalized_value", "f.normalized_numeric", "f.reason", F.array_join("f.candidates", "|").alias("candidates"))


@register("ext_11_fields", f"{whole.FIELDS_SQL} SELECT item_id, field_name, status, raw_text, normalized_value, normalized_numeric, unit, reason, source, array_to_string(candidates, '|') AS candidates FROM f")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fields(records(spark, sf_dir)).select("item_id", "field_name", "status", "raw_text", "normalized_value", "normalized_numeric", c("normalized_unit").alias("unit"), "reason", "source", F.array_join("candidates", "|").alias("candidates"))


def checks(spark: SparkSession, sf_dir: str, run: Stages, comparison: bool = True, of: Callable[[SparkSession, str], DataFrame] = labels) -> DataFrame:
    """All five checks of every record, from text to result; the fields are stored."""
    found = run.store("fields", extract.fields(records(spark, sf_dir, of)), keep=True)
    app = F.when(c("field_name") == "brand_name", c("app_brand")).when(c("field_name") == "class_type", c("app_class")).when(c("field_name") == "alcohol_content", c("app_abv")).when(c("field_name") == "net_contents", c("app_net"))
    return rules.run(found.select("item_id", "batch_id", "field_at", "field_name", "quality", *reconcile.VALUES, app.alias("app_value")), rules.rules_of(comparison), keep=True)


def _verdicts(comparison: bool, of: Callable[[SparkSession, str], DataFrame] = labels):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks(spark, sf_dir, Stages(spark), comparison, of).select("item_id", "check_name", "status", "reason_code", c("underlying_reason_code").alias("underlying"), c("ai_assist_eligible").alias("eligible"), "detected_value")

    return run


VERDICTS = "SELECT item_id, check_name, status, reason_code, underlying, eligible, shown AS detected_value FROM k"
register("rul_08_checks", f"{whole.checks()} {VERDICTS}")(_verdicts(True))
register("rul_08_checks_label_only", f"{whole.checks(False)} {VERDICTS}")(_verdicts(False))

# The same over records with missing, empty and foreign lines.
odd = lambda sql: sql.replace(o.L, f"WITH l AS ({ODD})")
register("rul_08_odd_checks", odd(f"{whole.checks()} {VERDICTS}"))(_verdicts(True, odd_labels))
register("rul_08_odd_checks_label_only", odd(f"{whole.checks(False)} {VERDICTS}"))(_verdicts(False, odd_labels))


@register("ext_11_odd_fields", odd(f"{whole.FIELDS_SQL} SELECT item_id, field_name, status, raw_text, normalized_value, normalized_numeric, unit, reason, source, array_to_string(candidates, '|') AS candidates FROM f"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fields(records(spark, sf_dir, odd_labels)).select("item_id", "field_name", "status", "raw_text", "normalized_value", "normalized_numeric", c("normalized_unit").alias("unit"), "reason", "source", F.array_join("candidates", "|").alias("candidates"))


# Items none of whose checks failed; a poor picture's reason gives way to the one beneath it.
ELIGIBLE = o.array(reconcile.ELIGIBLE_REASONS)
WHY = f"CASE WHEN list_contains({ELIGIBLE}, reason_code) THEN reason_code WHEN list_contains({ELIGIBLE}, underlying) THEN underlying END"


@register("rec_10_requests", f"""{whole.checks()}, i AS (SELECT item_id FROM k GROUP BY 1 HAVING bool_or(status = 'REVIEW') AND NOT bool_or(status = 'FAIL')), e AS (SELECT *, {WHY} AS why FROM k JOIN i USING (item_id) WHERE status = 'REVIEW' AND reason_code NOT IN {tuple(reconcile.HUMAN_ONLY_REASONS)} AND (eligible OR reason_code = 'OCR_LOW_QUALITY'))
SELECT item_id, quality, row_number() OVER (PARTITION BY item_id ORDER BY field_at) - 1 AS at, field_name AS field, why AS reason, raw_text AS ocr_text, array_to_string(candidates, '|') AS candidates, app AS application_value, extraction_status, e.reason AS extraction_reason FROM e WHERE why IS NOT NULL""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Stages(spark)
    # Checks go into the requests' one aggregate as they are judged; nothing else reads them.
    asked = reconcile.requests(checks(spark, sf_dir, run))
    return asked.select("item_id", "quality", F.posexplode("fields").alias("at", "x")).select("item_id", "quality", "at", "x.field", "x.reason", "x.ocr_text", F.array_join("x.candidates", "|").alias("candidates"), "x.application_value", "x.extraction_status", "x.extraction_reason")


STATUSES = ("brand_status", "class_type_status", "alcohol_content_status", "net_contents_status", "government_warning_status")
CELL = lambda x: f"CASE WHEN regexp_matches(s.{x}, '[\",\\r\\n]') THEN '\"' || replace(s.{x}, '\"', '\"\"') || '\"' ELSE s.{x} END"
SAFE = lambda x: f"CASE WHEN regexp_matches({x}, '^[=+@\\t\\r-]') THEN chr(39) || {x} ELSE coalesce({x}, '') END"
EXPORTED = {
    "filename": "filename", "processing_state": "'COMPLETED'", "overall_status": "overall_status", "brand_name": "app_brand", "class_type": "app_class", "alcohol_content": "app_abv", "net_contents": "app_net",
    **{n: n for n in STATUSES}, "ai_assisted": "'false'", "processing_time_ms": "printf('%.1f', size * 1.5::DOUBLE)", "review_reason_codes": "codes", "error_code": "NULL::VARCHAR", "error": "NULL::VARCHAR",
}


@register("snk_01_batch_export", f"""{whole.checks()}, i AS (SELECT item_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS overall_status, string_agg(reason_code, ';' ORDER BY field_at) FILTER (status = 'REVIEW') AS codes, {", ".join(f"max(status) FILTER (field_at = {i}) AS {n}" for i, n in enumerate(STATUSES))} FROM k GROUP BY 1),
s AS (SELECT item_id, {", ".join(f"{SAFE(EXPORTED[x])} AS {x}" for x in EXPORT_COLUMNS)} FROM i JOIN l USING (item_id)) SELECT item_id, concat_ws(',', {", ".join(CELL(x) for x in EXPORT_COLUMNS)}) AS line FROM s""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Stages(spark)
    done = run.store("checks", checks(spark, sf_dir, run), keep=True)
    run.forget("fields")
    per = summary.items(done, "item_id").select("item_id", "overall_status", "review_reason_codes")
    none = F.lit(None).cast("string")
    base = labels(spark, sf_dir).select("item_id", "filename", F.lit("COMPLETED").alias("processing_state"), c("app_brand").alias("brand_name"), c("app_class").alias("class_type"), c("app_abv").alias("alcohol_content"), c("app_net").alias("net_contents"), F.lit(False).alias("ai_assisted"), (c("size") * 1.5).cast("double").alias("processing_time_ms"), none.alias("error_code"), none.alias("error_message"))
    return exports.batch_rows(base.join(per, "item_id"), done).select("item_id", exports.csv_line([c(x) for x in EXPORT_COLUMNS]).alias("line"))


# Up to three answers on the alcohol content of each record, some of them no use.
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = c("item_id"), c("at")
    abv = lambda x: F.concat(x.cast("string"), F.lit("% Alc./Vol."))
    kind = (n + k) % 5
    said = F.when(kind == 0, abv(c("size") + 3)).when(kind == 1, F.concat(c("size").cast("string"), F.lit("% ABV"))).when(kind == 2, F.concat((2 * c("size")).cast("string"), F.lit(" Proof"))).when(kind == 3, F.concat(F.lit(" "), abv(c("size")), F.lit(" ("), (2 * c("size")).cast("string"), F.lit(" PROOF)")))
    sure = F.when((n + 2 * k) % 4 == 1, "MEDIUM").when((n + 2 * k) % 4 == 2, "LOW").otherwise("HIGH")
    each = labels(spark, sf_dir).where("item_id % 4 > 0").select("item_id", "size", F.explode(F.sequence(F.lit(1), (n % 4).cast("int"))).alias("at"))
    return each.select("item_id", F.lit("alcohol_content").alias("field_name"), "at", said.alias("candidate_value"), F.when(kind == 4, " ").alias("raw_observed_text"), sure.alias("confidence"), ((n + k) % 17 == 0).alias("unable_to_determine"))


def _added(seen: str, text: str) -> str:
    return f"CASE WHEN list_contains({seen}, {text}) THEN {seen} ELSE list_append({seen}, {text}) END"


def _answer(table: str, k: int) -> str:
    """The state of each field (status, raw, value, number, source, why, outcomes) after its k-th answer, from the state before."""
    kind = f"(item_id + {k}) % 5"
    said = f"CASE {kind} WHEN 0 THEN (size + 3) || '% Alc./Vol.' WHEN 1 THEN size || '% ABV' WHEN 2 THEN (2 * size) || ' Proof' WHEN 3 THEN size || '% Alc./Vol. (' || (2 * size) || ' PROOF)' ELSE '' END"
    sure = f"CASE (item_id + {2 * k}) % 4 WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'HIGH' END"
    one = f"SELECT *, {said} AS said, {sure} AS sure, coalesce(nullif(raw, ''), value) AS ocr FROM {table}"
    two = f"SELECT *, {o.abv('said')} AS x, {o.proof('said')} AS xp, {o.source('said')} AS xs, {o.abv('ocr')} AS y, {o.proof('ocr')} AS yp, {o.source('ocr')} AS ys FROM ({one})"
    near = "coalesce(trim(ocr) <> '' AND said <> '' AND CASE WHEN ys = 'proof' AND xs IN ('abv', 'both') THEN NOT coalesce(abs(xp - yp) > 0.6, false) AND abs(x - yp / 2) <= 0.6 ELSE abs(y - x) <= 0.5 END, false)"
    bad = f"CASE WHEN (item_id + {k}) % 17 = 0 THEN 'unable_to_determine' WHEN sure = 'LOW' THEN 'low_confidence' WHEN said = '' THEN 'empty_text' WHEN x IS NULL OR xs = 'proof' THEN 'abv_unparseable' END"
    three = f"SELECT *, {near} AS near, coalesce(abs(y - x) > 0.5, false) AS far, {bad} AS bad FROM ({two})"
    outcome = "CASE WHEN bad IS NOT NULL THEN 'rejected:' || bad WHEN status = 'FOUND' THEN CASE WHEN near THEN 'supplemented' WHEN far THEN 'conflict' ELSE 'kept_ocr' END WHEN status = 'UNCERTAIN' AND coalesce(raw, '') <> '' AND far AND NOT near THEN 'conflict' ELSE 'filled' END"
    four = f"SELECT *, CASE WHEN item_id % 4 >= {k} THEN {outcome} END AS oc FROM ({three})"
    used = "oc IN ('supplemented', 'filled')"
    return f"""SELECT item_id, size, batch_id, quality, CASE WHEN oc = 'conflict' THEN 'UNCERTAIN' WHEN oc = 'supplemented' THEN 'FOUND' WHEN oc = 'filled' THEN CASE WHEN sure = 'HIGH' OR sure = 'MEDIUM' AND near THEN 'FOUND' ELSE 'UNCERTAIN' END ELSE status END AS status,
  CASE WHEN oc = 'supplemented' AND xs = 'abv' THEN {o.abv_span('said')} WHEN {used} THEN said ELSE raw END AS raw, CASE WHEN {used} THEN {o.abv_display('said')} ELSE value END AS value, CASE WHEN {used} THEN x ELSE number END AS number, CASE WHEN {used} THEN xs ELSE source END AS source,
  CASE WHEN oc = 'conflict' THEN 'CONFLICTING_EVIDENCE' ELSE why END AS why, CASE WHEN oc IS NULL THEN outcomes ELSE list_append(outcomes, oc) END AS outcomes, CASE WHEN {used} OR oc = 'conflict' THEN {_added(_added("seen", "coalesce(raw, '')"), "said")} ELSE seen END AS seen FROM ({four})"""


STEPS = f"""s0 AS (SELECT f.item_id, size, batch_id, quality, status, raw_text AS raw, normalized_value AS value, normalized_numeric AS number, source, reason AS why, CAST([] AS VARCHAR[]) AS outcomes, CAST(candidates AS VARCHAR[]) AS seen FROM f JOIN l USING (item_id) WHERE field_at = 2),
s1 AS ({_answer("s0", 1)}), s2 AS ({_answer("s1", 2)}), s3 AS ({_answer("s2", 3)})"""


def alcohol_fields(spark: SparkSession, sf_dir: str, run: Stages) -> DataFrame:
    return run.store("fields", extract.fields(records(spark, sf_dir), ["alcohol_content"]), keep=True)


@register("joi_08_answers", f"{whole.FIELDS_SQL}, {STEPS} SELECT item_id, 'alcohol_content' AS field_name, status, raw AS raw_text, value AS normalized_value, number AS normalized_numeric, source, why AS reason, array_to_string(outcomes, ';') AS outcomes, outcomes[-1] AS outcome, coalesce(len(list_filter(outcomes, lambda x: x IN ('supplemented', 'filled', 'conflict'))) > 0, false) AS updated, array_to_string(seen, '|') AS candidates FROM s3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = evidence.merge(alcohol_fields(spark, sf_dir, Stages(spark)), answers(spark, sf_dir))
    return merged.select("item_id", "field_name", "status", "raw_text", "normalized_value", "normalized_numeric", "source", "reason", F.array_join("outcomes", ";").alias("outcomes"), "outcome", "updated", F.array_join("candidates", "|").alias("candidates"))


# From evidence to annotated checks: rules, requests, answers of a provider that is away, silent or broken for some items, and rules again.
AWAY, BROKEN, SILENT = 7, 13, 11
POOR = "quality IN ('WARNING', 'POOR')"
EV = "concat_ws(' ', nullif(raw, ''), nullif(value, ''))"
AGAIN_REASON = f"""CASE WHEN status = 'UNCERTAIN' THEN CASE WHEN why = 'CONFLICTING_EVIDENCE' THEN why WHEN {POOR} THEN 'OCR_LOW_QUALITY' ELSE 'EXTRACTION_UNCERTAIN' END WHEN status = 'NOT_FOUND' THEN CASE WHEN {POOR} THEN 'OCR_LOW_QUALITY' ELSE 'EXTRACTION_NOT_FOUND' END
  WHEN {o.authorized(EV)} THEN 'ABV_MATCH' WHEN source = 'proof' OR {o.source(EV)} = 'proof' THEN 'PROOF_ONLY_NO_PERCENT_STATEMENT' ELSE 'ABV_FORMAT_REVIEW' END"""
ASSISTED = f"""{whole.checks(False)}, {STEPS},
i AS (SELECT item_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS before, bool_or(status = 'REVIEW' AND reason_code NOT IN {tuple(reconcile.HUMAN_ONLY_REASONS)} AND (eligible OR reason_code = 'OCR_LOW_QUALITY') AND {WHY} IS NOT NULL) AS may FROM k GROUP BY 1),
j AS (SELECT item_id, before, before = 'REVIEW' AND may AS el FROM i), ok AS (SELECT item_id FROM j WHERE el AND item_id % {AWAY} > 0 AND item_id % {BROKEN} > 0 AND item_id % {SILENT} > 0),
z AS (SELECT * FROM s3 SEMI JOIN ok USING (item_id)), y AS (SELECT item_id, outcomes[-1] AS last, len(list_filter(outcomes, lambda x: x IN ('supplemented', 'filled', 'conflict'))) > 0 AS changed, {AGAIN_REASON} AS again FROM z),
w AS (SELECT j.*, coalesce(changed, false) AS changed, last, again, CASE WHEN item_id % 3 = 0 THEN 'ocr_plus_enhanced' ELSE 'ocr_only' END AS method,
  CASE WHEN el AND item_id % {AWAY} = 0 THEN 'provider_unavailable' WHEN el AND item_id % {BROKEN} = 0 THEN 'provider_exception' WHEN el AND item_id % {SILENT} = 0 THEN 'provider_not_called' WHEN el AND changed THEN 'evidence_merged' WHEN el THEN 'no_usable_evidence' WHEN before = 'REVIEW' THEN 'not_eligible' ELSE 'not_needed_' || lower(before) END AS outcome FROM j LEFT JOIN y USING (item_id))
SELECT item_id, check_name, CASE WHEN field_at = 2 AND changed THEN CASE WHEN again = 'ABV_MATCH' THEN 'PASS' ELSE 'REVIEW' END ELSE status END AS status, CASE WHEN field_at = 2 AND changed THEN again ELSE reason_code END AS reason_code, outcome, el AS eligible,
  CASE outcome WHEN 'evidence_merged' THEN CASE WHEN last = 'conflict' THEN 'ocr_plus_ai_conflict' ELSE 'ocr_plus_ai' END WHEN 'no_usable_evidence' THEN method || '_ai_rejected' WHEN 'provider_exception' THEN method || '_ai_failed' WHEN 'provider_unavailable' THEN method || '_ai_unavailable' WHEN 'provider_not_called' THEN method || '_ai_unavailable' ELSE method END AS evidence_method,
  CASE WHEN field_at = 2 AND changed THEN true END AS assisted, CASE WHEN field_at = 2 AND changed THEN last END AS merged, CASE WHEN el AND outcome <> 'evidence_merged' THEN CASE outcome WHEN 'provider_not_called' THEN 'not_called' ELSE outcome END END AS failure, 'why' || CASE WHEN field_at = 2 AND changed THEN {q(rules.CONSIDERED)} ELSE '' END AS explanation
FROM k JOIN w USING (item_id)"""


@register("rul_13_assisted", ASSISTED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("item_id")
    run = Stages(spark)
    before = run.store("checks", checks(spark, sf_dir, run, comparison=False), keep=True)
    asked = reconcile.requests(before).select("item_id", F.lit(True).alias("eligible"))
    overall = before.groupBy("item_id").agg(rules.worst(F.collect_set("status")).alias("status_before"))
    items = run.store("items", overall.join(asked, "item_id", "left").select("item_id", "status_before", "eligible", F.lit(True).alias("configured"), (n % AWAY > 0).alias("available"), (n % BROKEN == 0).alias("raised"), (n % SILENT > 0).alias("called"), F.lit(True).alias("answered"), F.when(n % 3 == 0, "ocr_plus_enhanced").otherwise("ocr_only").alias("method")), keep=True)
    reached = items.where("eligible and available and called and not raised").select("item_id")
    fields = spark.read.parquet(run.path("fields"))
    merged = run.store("merged", evidence.merge(fields.select(*evidence.KEYS, *reconcile.VALUES), answers(spark, sf_dir).join(reached, "item_id", "left_semi")), keep=True)
    known = merged.where("status is not null").join(fields.select(*evidence.KEYS, "field_at", "quality"), evidence.KEYS)
    after = rules.run(known.select("item_id", "field_at", "field_name", "quality", F.lit(None).cast("string").alias("app_value"), *reconcile.VALUES), rules.rules_of(False)).withColumn("explanation", F.lit("why"))
    marks = {"ai_assist_outcome": "outcome", "ai_eligible_for_review": "eligible", "ai_assisted_evidence": "assisted", "ai_merge_outcome": "merged", "ai_failure_category": "failure"}
    return rules.annotate(after, evidence.assistance(items, merged)).select("item_id", "check_name", "status", "reason_code", "evidence_method", *(c(k).alias(v) for k, v in marks.items()), "explanation")


# Where values go: two passes, what was made of them, answers, and the rule, for alcohol statements.
def alcohol_stages(spark: SparkSession, sf_dir: str, run: Stages) -> tuple[dict[str, DataFrame], DataFrame]:
    fast, enhanced = (df.where("field_name = 'alcohol_content'") for df in two_passes(spark, sf_dir))
    fast = run.store("fast", fast, keep=True)
    # The second look runs for two records of three, and reads nothing in one of seven.
    second = enhanced.where("item_id % 3 < 2").withColumns({"status": F.when(c("item_id") % 7 == 0, "NOT_FOUND").otherwise(c("status")), "raw_text": F.when(c("item_id") % 7 != 0, c("raw_text")), "normalized_value": F.when(c("item_id") % 7 != 0, c("normalized_value"))})
    second = run.store("enhanced", second, keep=True)
    reconciled = run.store("reconciled", reconcile.merge_passes(fast, second), keep=True)
    answered = run.store("answered", evidence.merge(reconciled, answers(spark, sf_dir)), keep=True)
    judged = rules.run(answered.join(labels(spark, sf_dir).select("item_id", "quality"), "item_id").select(*evidence.KEYS, "quality", F.lit(None).cast("string").alias("app_value"), *reconcile.VALUES), rules.rules_of(False))
    checks_ = judged.select("item_id", rules.field_of(c("check_name")).alias("field_name"), "status", "reason_code")
    return {"fast": fast, "enhanced": second, "reconciled": reconciled, "answered": answered}, checks_


_SECOND = "CASE WHEN item_id % 3 = 0 THEN (size + 1) || '% ABV' ELSE abv_line END"
_MERGED = f"item_id % 3 < 2 AND item_id % 7 > 0 AND {o.source('abv_line')} IS NOT NULL AND {o.source(_SECOND)} IS NOT NULL AND abs({o.abv('abv_line')} - {o.abv(_SECOND)}) > 1e-6"
LOSS_STATES = f"""s0 AS (SELECT item_id, size, batch_id, quality, CASE WHEN {o.source('abv_line')} IS NULL THEN 'NOT_FOUND' WHEN {_MERGED} THEN 'UNCERTAIN' ELSE 'FOUND' END AS status, CASE WHEN {o.source('abv_line')} IS NOT NULL THEN abv_line END AS raw, {o.abv_display('abv_line')} AS value, {o.abv('abv_line')} AS number, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS why, CAST([] AS VARCHAR[]) AS outcomes, CAST([] AS VARCHAR[]) AS seen FROM l),
s1 AS ({_answer("s0", 1)}), s2 AS ({_answer("s1", 2)}), s3 AS ({_answer("s2", 3)}),
ru AS (SELECT item_id, status AS last_status, CASE WHEN status = 'FOUND' AND {o.authorized(EV)} THEN 'PASS' ELSE 'REVIEW' END AS rule_status, {AGAIN_REASON} AS rule_reason FROM s3),
st AS (SELECT item_id, 0 AS place, 'fast' AS stage, {o.abv_display('abv_line')} AS v FROM l UNION ALL SELECT item_id, 1, 'enhanced', CASE WHEN item_id % 7 > 0 THEN {o.abv_display(_SECOND)} END FROM l WHERE item_id % 3 < 2 UNION ALL SELECT item_id, 2, 'reconciled', value FROM s0 UNION ALL SELECT item_id, 3, 'answered', value FROM s3),
sw AS (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS n, last_value(v IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM st WINDOW w AS (PARTITION BY item_id ORDER BY place)),
sl AS (SELECT item_id, min(place) FILTER (v IS NULL AND before IS NOT NULL) AS gone FROM sw GROUP BY 1),
so AS (SELECT item_id, arg_min(stage, place) FILTER (v IS NOT NULL) AS first_at, arg_min(stage, place) FILTER (place = gone) AS lost_at, arg_min(before, place) FILTER (place = gone) AS lost, arg_min(stage, place) FILTER (place > gone AND v IS NOT NULL AND before IS NULL) AS regained_at,
  arg_min(stage, place) FILTER (lower(v) <> lower(known)) AS changed_at, arg_max(v, place) FILTER (v IS NOT NULL) AS last_shown, bool_or(place = 3 AND v IS NOT NULL) AS kept, bool_or(n = 1 AND v IS NOT NULL) AS early, string_agg(stage || ':' || coalesce(v, '-'), ' ' ORDER BY place) AS states FROM sw JOIN sl USING (item_id) GROUP BY 1)"""


@register("svc_06_losses", f"""{o.L}, {LOSS_STATES} SELECT item_id, states, first_at, lost_at, lost, regained_at, changed_at, last_shown, last_status, rule_status, rule_reason,
  CASE WHEN first_at IS NULL THEN 'never' WHEN NOT kept THEN 'lost' WHEN lost_at IS NOT NULL THEN 'regained' WHEN NOT early THEN 'late' WHEN changed_at IS NOT NULL THEN 'changed' ELSE 'kept' END AS outcome FROM so JOIN ru USING (item_id)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = diagnose.losses(*alcohol_stages(spark, sf_dir, Stages(spark)))
    path = F.array_join(F.transform("states", lambda x: F.concat(x["stage"], F.lit(":"), F.when(x["held"], x["shown"]).otherwise("-"))), " ")
    return lost.select("item_id", path.alias("states"), "first_at", "lost_at", "lost", "regained_at", "changed_at", "last_shown", "last_status", "rule_status", "rule_reason", "outcome")


# Live batches: three waves of events, each followed by a run that goes on from the checkpoint of the one before.
BEGAN = 1_704_067_200
_ENDS = "CASE item_id % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END"
WAVES = (
    (("queued", 0, "true"), ("queued", 0, "item_id % 5 = 0"), ("started", 120, "item_id % 3 < 2"), ("finished", 300, "item_id % 3 = 0")),
    (("started", 180, "item_id % 3 = 2"), ("started", 120, "item_id % 3 = 0"), ("failed", 360, "item_id % 3 = 1")),
    (("finished", 480, "item_id % 3 = 2 AND item_id % 10 > 0"), ("finished", 400, "item_id % 3 = 1"), ("queued", 12_000, "item_id = (SELECT max(item_id) FROM records)")),
)


@register("svc_01_lifecycle", f"""{o.L}, e AS (SELECT batch_id, item_id, item_id % 60 AS s FROM l), x AS (SELECT batch_id, item_id, 'QUEUED' AS state, {BEGAN} + s AS second, CAST(NULL AS VARCHAR) AS overall_status, CAST(NULL AS DOUBLE) AS processing_time_ms, CAST(NULL AS VARCHAR) AS error_code FROM e
UNION ALL SELECT batch_id, item_id, 'PROCESSING', {BEGAN} + s + CASE WHEN item_id % 3 = 2 THEN 180 ELSE 120 END, NULL, NULL, NULL FROM e
UNION ALL SELECT batch_id, item_id, CASE WHEN item_id % 3 = 1 OR item_id % 3 = 2 AND item_id % 10 = 0 THEN 'ERROR' ELSE 'COMPLETED' END, {BEGAN} + s + CASE WHEN item_id % 3 = 0 THEN 300 WHEN item_id % 3 = 1 THEN 360 WHEN item_id % 10 > 0 THEN 480 ELSE 180 + 1800 END, CASE WHEN item_id % 3 = 0 OR item_id % 3 = 2 AND item_id % 10 > 0 THEN {_ENDS} END,
  CASE WHEN item_id % 3 = 2 AND item_id % 10 = 0 THEN NULL ELSE (item_id % 50)::DOUBLE END, CASE WHEN item_id % 3 = 1 THEN CASE WHEN item_id % 2 = 0 THEN 'ocr_unavailable' ELSE 'processing_exception' END WHEN item_id % 3 = 2 AND item_id % 10 = 0 THEN 'processing_timeout' END FROM e)
SELECT batch_id, CAST(item_id AS VARCHAR) AS item_id, state, second, overall_status, processing_time_ms, error_code FROM x""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Stages(spark)
    labels(spark, sf_dir).select("item_id", "batch_id").createOrReplaceTempView("records")
    parts = max(16, 2 * spark.sparkContext.defaultParallelism)
    for wave in WAVES:
        # The last wave's one late event only moves the clock; its item was queued long ago.
        each = " UNION ALL ".join(f"SELECT batch_id, CAST(item_id AS STRING) AS item_id, '{kind}' AS event, timestamp_seconds({BEGAN} + item_id % 60 + {after}) AS ts, CASE WHEN '{kind}' = 'finished' THEN {_ENDS} END AS overall_status, CASE WHEN '{kind}' IN ('finished', 'failed') THEN CAST(item_id % 50 AS DOUBLE) END AS processing_time_ms, CASE WHEN '{kind}' = 'failed' AND item_id % 2 = 0 THEN 'ocr_unavailable' END AS error_code FROM records WHERE {which}" for kind, after, which in wave)
        spark.sql(each).coalesce(parts).write.mode("append").json(run.path("events"))
        live.follow(live.moves(live.arrivals(spark, run.path("events"), 1000), shares=4096), run.path("moves"), run.path("checkpoint"), parts).awaitTermination()
    return live.read(spark, run.path("moves")).select("batch_id", "item_id", "state", F.unix_seconds("at").alias("second"), "overall_status", "processing_time_ms", "error_code")


@register("svc_02_timings", f"""{whole.checks(False)}, n AS (SELECT 0 AS place, 'fields' AS stage, count(*) AS n_rows, count(*) FILTER (status = 'FOUND')::DOUBLE AS hits FROM f UNION ALL SELECT 1, 'checks', count(*), count(*) FILTER (status = 'PASS')::DOUBLE FROM k
UNION ALL SELECT 2, 'items', count(*), count(*) FILTER (s = 'REVIEW')::DOUBLE FROM (SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS s FROM k GROUP BY item_id)) SELECT *, true AS timed FROM n""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda state: F.count_if(c("status") == state)
    with Stages(spark) as run:
        fields = run.store("fields", extract.fields(records(spark, sf_dir)), hits=found("FOUND"))
        judged = run.store("checks", rules.run(fields.select("item_id", "field_at", "field_name", "quality", *reconcile.VALUES, F.lit(None).cast("string").alias("app_value")), rules.rules_of(False)), hits=found("PASS"))
        run.store("items", summary.items(judged, "item_id"), hits=F.count_if(c("overall_status") == "REVIEW"))
        return run.timings().select("place", "stage", "n_rows", c("metrics")["hits"].alias("hits"), (c("elapsed_ms") > 0).alias("timed"))


# The store of batch jobs: one batch is put a second time, with the items that were not in error.
@register("snk_11_jobs", f"WITH i AS ({ITEMS}) SELECT batch_id, CAST(item_id AS VARCHAR) AS item_id, filename, processing_state, overall_status, ai_assisted FROM i WHERE batch_id = '5-LOW' OR batch_id = '1-URGENT' AND processing_state <> 'ERROR'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = jobs.JobStore(spark, Stages(spark).path("jobs"))
    columns = [field.strip().split(" ")[0] for field in jobs.ITEMS.split(",")]
    every = items(spark, sf_dir)
    rows = every.select(*(c(x) if x in every.columns else F.lit(None).alias(x) for x in columns)).selectExpr(*(f"CAST({f.strip().split(' ')[0]} AS {f.strip().split(' ')[1]}) AS {f.strip().split(' ')[0]}" for f in jobs.ITEMS.split(",")))
    store.put(rows, files=4)
    store.put(rows.where("batch_id = '1-URGENT' AND processing_state <> 'ERROR'"), files=4)
    return store.get("1-URGENT", "5-LOW").select("batch_id", "item_id", "filename", "processing_state", "overall_status", "ai_assisted")


# Manifests in number: one file for each batch of label records, read at once.
@register("src_01_manifests", f"{o.L} SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY item_id) + 1 AS row_number, trim(filename) AS filename, trim(brand_line) AS brand_name, app_class AS class_type, app_abv AS alcohol_content, '' AS net_contents, CAST(NULL AS VARCHAR) AS problem FROM l")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stages(spark).path("manifests")
    made = labels(spark, sf_dir).repartition("batch_id").sortWithinPartitions("batch_id", "item_id")
    made.select("batch_id", c("filename").alias("Filename"), c("brand_line").alias(" brand_name "), c("app_class").alias("class_type"), F.concat(F.lit(" "), "app_abv").alias("ALCOHOL_CONTENT"), F.lit(" ").alias("net_contents")).write.partitionBy("batch_id").option("header", True).csv(path)
    return readers.manifests(spark, f"{path}/*/*.csv").withColumn("batch_id", F.regexp_extract("path", "batch_id=([^/]+)/", 1)).drop("path")


# The single report of every record, from its checks: all rows, headings included.
META = ("'R-' || item_id", "strftime(to_timestamp(1700000000 + item_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')", "filename", "'LABEL_ONLY'", "overall", "printf('%.1f', size * 1.25::DOUBLE)", "CASE WHEN item_id % 2 = 0 THEN 'Yes' ELSE 'No' END", "passed::VARCHAR", "reviewed::VARCHAR", "failed::VARCHAR")
FIELD_TEXT = "CASE WHEN status IS NULL THEN 'Not extracted' WHEN field_at < 4 THEN coalesce(nullif(raw_text, ''), nullif(normalized_value, ''), status) WHEN status = 'FOUND' THEN 'Detected — ' || substr(raw_text, 1, 200) ELSE status || ': ' || coalesce(nullif(raw_text, ''), 'why ' || item_id) END"


@register("snk_06_single_rows", f"""{whole.checks(False)}, i AS (SELECT item_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS overall, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'REVIEW') AS reviewed, count(*) FILTER (status = 'FAIL') AS failed FROM k GROUP BY 1),
zm AS (SELECT item_id, unnest(range(11)) AS place, 'metadata' AS section, unnest([['{exports.SECTIONS[0]}'], {", ".join(f"['{n}', {SAFE(v)}]" for n, v in zip(exports.METADATA, META, strict=True))}]) AS cells FROM i JOIN l USING (item_id)),
zd AS (SELECT item_id, 12 + field_at AS place, 'fields' AS section, [{o.array(exports.FIELD_LABELS)}[field_at + 1], {SAFE('t')}] AS cells FROM (SELECT item_id, field_at, {FIELD_TEXT} AS t FROM (SELECT item_id, field_at, raw_text, normalized_value, CASE WHEN item_id % 6 = 0 AND field_at = 3 THEN NULL ELSE status END AS status FROM f))),
zh AS (SELECT item_id, unnest([11, 17, 18]) AS place, unnest(['fields', 'checks', 'checks']) AS section, unnest([['{exports.SECTIONS[1]}'], ['{exports.SECTIONS[2]}'], {o.array(exports.CHECK_COLUMNS)}]) AS cells FROM i),
zj AS (SELECT item_id, 19 + field_at AS place, 'checks' AS section, [check_name, status, {SAFE('shown')}, chr(39) || '=why', coalesce(reason_code, ''), CASE WHEN item_id % 3 = 0 THEN 'Yes' ELSE 'No' END] AS cells FROM k)
SELECT item_id, place, section, array_to_string(cells, '|') AS line FROM (SELECT * FROM zm UNION ALL SELECT * FROM zd UNION ALL SELECT * FROM zh UNION ALL SELECT * FROM zj)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("item_id")
    run = Stages(spark)
    judged = run.store("checks", checks(spark, sf_dir, run, comparison=False).withColumns({"explanation": F.lit("=why"), "ai_assisted_evidence": F.when(n % 3 == 0, True)}), keep=True)
    per = summary.items(judged, "item_id")
    base = labels(spark, sf_dir).select("item_id", F.concat(F.lit("R-"), n).alias("review_id"), F.timestamp_seconds(1_700_000_000 + n).alias("generated"), "filename", F.lit("LABEL_ONLY").alias("mode"), (c("size") * 1.25).alias("processing_time_ms"), (n % 2 == 0).alias("ai_assisted"))
    fields = spark.read.parquet(run.path("fields")).where("NOT (item_id % 6 = 0 AND field_at = 3)").withColumn("explanation", F.concat(F.lit("why "), n))
    return exports.single_rows(base.join(per, "item_id"), fields, judged).select("item_id", c("at").alias("place"), "section", F.array_join("cells", "|").alias("line"))


# The evaluation report, line by line.
ASKED_PROFILES, ASKED_EDGES = ["fast", "enhanced", "none"], [1200, 1600, 2200, 9999]
MANY = {"generated": "2024-05-01", "environment": {"os": "any", "cpus": "8"}, "requested": ["engine0", "engine1", "engine2"], "available": ["engine0", "engine1"], "unavailable": {"engine2": "not installed"}, "profiles": ASKED_PROFILES, "edges": ASKED_EDGES}
RECOVERY = {name: f"(fields_recovered + {i}) % 4 = 0" for i, name in enumerate(evaluate.RECOVERED)}
FIRST = [(s, i, x) for s, lines in enumerate(evaluate._fixed_lines(**MANY)) for i, x in enumerate(lines)] + [
    (s, i, x)
    for s, lines in enumerate(((*evaluate.BOARD_HEAD,), ("| Provider | " + " | ".join(evaluate.RECOVERED) + " |", "|---|" + "|".join(["---:"] * 5) + "|"), (), (), (), ()), 3)
    for i, x in enumerate((evaluate.HEADINGS[s], "", *lines))
]
P = lambda spec, x: f"printf('{spec}', {x}::DOUBLE)"
POOL = "avg(fields_recovered) AS mean_fields, coalesce(avg(cer), 1.0) AS mean_cer, quantile_cont(total_ms, 0.5) AS median_ms"
ASKED = lambda section, values, column, line: f"SELECT {section}, i + 2, {line} FROM (SELECT unnest(range({len(values)})) AS i, unnest({values}) AS v) LEFT JOIN (SELECT {column} AS v, {POOL} FROM t GROUP BY 1) USING (v)"
RANKED = "row_number() OVER (ORDER BY mean_fields DESC, median_ms, mean_cer, provider, profile, edge)"
CHOSEN = f"provider || ' / ' || profile || ' / ' || edge || 'px** (mean fields ' || {P('%.2f', 'mean_fields')}"


@register("snk_09_report", f"""{T}, x(section, place, line) AS (VALUES {", ".join(f"({s}, {i}, {q(text)})" for s, i, text in FIRST)}), r AS (SELECT *, {RANKED} AS n_ FROM b),
w AS (SELECT *, {RANKED} AS k FROM b WHERE median_ms <= 2000 AND mean_fields >= 3.0), e AS (SELECT coalesce(failure_kind, 'unknown') AS kind, count(*) AS n FROM t WHERE NOT success GROUP BY 1)
SELECT section, place::BIGINT AS place, line FROM (SELECT * FROM x
UNION ALL SELECT 3, n_ + 3, '| ' || provider || ' | ' || profile || ' | ' || edge || ' | ' || {P('%.2f', 'mean_fields')} || ' | ' || {P('%.3f', 'mean_cer')} || ' | ' || {P('%.0f', 'median_ms')} || ' | ' || {P('%.0f', 'p95_ms')} || ' | ' || {P('%.2f', 'box_rate')} || ' | ' || {P('%.2f', 'success_rate')} || ' |' FROM r
UNION ALL SELECT 4, row_number() OVER (ORDER BY provider) + 3, '| ' || provider || ' | ' || concat_ws(' | ', {", ".join(P('%.2f', f"avg(({x})::INT)") for x in RECOVERY.values())}) || ' |' FROM t GROUP BY provider
UNION ALL {ASKED(5, ASKED_PROFILES, "profile", f"'- **' || v || ':** mean fields=' || {P('%.2f', 'coalesce(mean_fields, 0)')} || ', median total=' || {P('%.0f', 'coalesce(median_ms, 0)')} || ' ms, mean CER=' || {P('%.3f', 'coalesce(mean_cer, 1)')}")}
UNION ALL {ASKED(6, ASKED_EDGES, "edge", f"'- **' || v || 'px:** mean fields=' || {P('%.2f', 'coalesce(mean_fields, 0)')} || ', median total=' || {P('%.0f', 'coalesce(median_ms, 0)')} || ' ms'")}
UNION ALL SELECT 7, row_number() OVER (ORDER BY n DESC, kind) + 1, '- `' || kind || '`: ' || n FROM e UNION ALL SELECT 7, 2, {q(evaluate.NO_FAILURES)} WHERE (SELECT count(*) FROM e) = 0
UNION ALL SELECT 8, 2, 'Top configuration by field recovery then latency: **' || {CHOSEN} || '/5, median ' || {P('%.0f', 'median_ms')} || ' ms).' FROM r WHERE n_ = 1
UNION ALL SELECT 8, 3, 'Best config with median total <= 2000 ms and mean fields >= 3.0: **' || {CHOSEN} || ', median ' || {P('%.0f', 'median_ms')} || ' ms).' FROM w WHERE k = 1 UNION ALL SELECT 8, 3, {q(evaluate.OVER_BUDGET)} WHERE (SELECT count(*) FROM w) = 0
UNION ALL SELECT unnest(range(3, 9)), 1099511627776, '')""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trials(spark, sf_dir).withColumn("field_recovery", F.create_map(*(x for name, test in RECOVERY.items() for x in (F.lit(name), F.expr(test)))))
    return evaluate.report(made, **MANY)
