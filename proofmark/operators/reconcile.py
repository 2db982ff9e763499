"""Choosing between recognition passes, merging what they disagree on, and merging outside evidence.

Fields are in long form: (item_id, field_name) with the columns of a field.
Every merge is a join on those two keys and a decision ladder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmark.config import CHECKS, ELIGIBLE_REASONS, HUMAN_ONLY_REASONS
from proofmark.functions import parse
from proofmark.functions.similarity import candidates_agree, prefer_agreeing, tokens
from proofmark.functions.text import comparison_normalize, strip
from proofmark.operators import evidence
from proofmark.operators.evidence import KEYS
from proofmark.operators.rules import field_of, worst

VALUES = ["status", "raw_text", "normalized_value", "normalized_numeric", "normalized_unit", "candidates", "reason", "source"]


def pass_scores(fields: DataFrame, *keys: str) -> DataFrame:
    """Per key: score (2 for a found field, 1 for an uncertain one) and the counts of the three states."""
    return fields.groupBy(*keys).agg(
        F.sum(F.when(F.col("status") == "FOUND", 2).when(F.col("status") == "UNCERTAIN", 1).otherwise(0)).alias("score"),
        F.count_if(F.col("status") == "FOUND").alias("n_found"),
        F.count_if(F.col("status") == "UNCERTAIN").alias("n_uncertain"),
        F.count_if(F.col("status") == "NOT_FOUND").alias("n_not_found"),
    )


def retry_reasons(n_not_found: Column, n_uncertain: Column, warning_status: Column, quality: Column, preview: Column, word_count: Column) -> Column:
    """Why an item needs a second pass; empty for none."""
    useful = F.length(strip(F.coalesce(preview, F.lit(""))))
    return F.array_compact(
        F.array(
            F.when(warning_status == "NOT_FOUND", "government_warning_not_found"),
            F.when(n_not_found >= 2, F.concat(F.lit("critical_fields_not_found="), n_not_found.cast("string"))),
            F.when((n_uncertain >= 2) & (n_not_found >= 1) & quality.isin("WARNING", "POOR"), "uncertain_fields_with_quality_issue_and_missing_field"),
            F.when((useful < 20) | ((word_count < 3) & (useful < 80)), "ocr_text_unusually_sparse"),
        )
    )


def select_pass(scores: DataFrame) -> DataFrame:
    """Per item the better profile: the higher score, then fewer fields not found, then fast."""
    rank = F.struct("score", (-F.col("n_not_found")).alias("nf"), (F.col("profile") == "fast").alias("fast"))
    return scores.groupBy("item_id").agg(F.max_by("profile", rank).alias("selected_profile"), F.max(F.when(F.col("profile") == "fast", F.col("score"))).alias("fast_score"), F.max(F.when(F.col("profile") == "enhanced", F.col("score"))).alias("enhanced_score"))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*KEYS, *(F.col(c).alias(f"{prefix}{c}") for c in VALUES))


def merge_passes(selected: DataFrame, other: DataFrame) -> DataFrame:
    """The selected pass, uncertain where both passes found a field and disagree.

    Numbers are compared without units; names that agree keep the more complete reading.
    """
    j = _renamed(selected, "").join(_renamed(other, "o_"), KEYS, "left")
    both = (F.col("status") == "FOUND") & (F.col("o_status") == "FOUND")
    numeric = F.col("normalized_numeric").isNotNull() & F.col("o_normalized_numeric").isNotNull()
    left, right = parse.first_of(F.col("normalized_value"), F.col("raw_text")), parse.first_of(F.col("o_normalized_value"), F.col("o_raw_text"))
    named = F.col("field_name").isin("brand_name", "class_type") & left.isNotNull() & right.isNotNull()
    agree = candidates_agree(left, right)
    better = F.coalesce(prefer_agreeing(left, right), left)
    differ = F.lower(strip(F.col("normalized_value"))) != F.lower(strip(F.col("o_normalized_value")))
    outcome = (
        F.when(~F.coalesce(both, F.lit(False)), "kept")
        .when(numeric, F.when(F.abs(F.col("normalized_numeric") - F.col("o_normalized_numeric")) > 1e-6, "conflict").otherwise("kept"))
        .when(named & agree, F.when(~better.eqNullSafe(F.col("normalized_value")), "cleaned").otherwise("kept"))
        .when(named & F.coalesce(differ, F.lit(False)), "conflict")
        .otherwise("kept")
    )
    j = j.withColumns({"outcome": outcome, "better": better, "better_raw": F.coalesce(prefer_agreeing(F.col("raw_text"), F.col("o_raw_text")), F.col("raw_text"))})
    seen = F.array_distinct(F.concat("candidates", F.array(F.coalesce("raw_text", F.lit("")), F.coalesce("o_raw_text", F.lit("")))))
    return j.select(
        *KEYS,
        F.when(F.col("outcome") == "conflict", "UNCERTAIN").otherwise(F.col("status")).alias("status"),
        F.when(F.col("outcome") == "cleaned", F.col("better_raw")).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(F.col("outcome") == "cleaned", F.col("better")).otherwise(F.col("normalized_value")).alias("normalized_value"),
        "normalized_numeric",
        "normalized_unit",
        F.when(F.col("outcome") != "kept", seen).otherwise(F.col("candidates")).alias("candidates"),
        "reason",
        "source",
        "outcome",
    )


def escalation_reasons(status: Column, reason: Column, issues: Column, prominent: Column, left_share: Column, short_tall: Column) -> Column:
    """Why a brand needs another look."""
    return F.array_compact(
        F.concat(
            F.array(
                F.when(status.isNull(), "brand_missing"),
                F.when(status == "NOT_FOUND", "brand_not_found"),
                F.when((status == "NOT_FOUND") & prominent, "prominent_text_without_brand"),
                F.when(status == "UNCERTAIN", F.concat(F.lit("uncertain:"), F.coalesce(reason, F.lit("unspecified")))),
            ),
            F.transform(F.coalesce(issues, F.array().cast("array<string>")), lambda i: F.concat(F.lit("integrity:"), i)),
            F.array(F.when((status == "FOUND") & (left_share >= 0.12), "left_inset"), F.when((status == "FOUND") & short_tall, "short_token_tall_glyphs")),
        )
    )


def reconcile_brand(base: Column, challenger: Column, suspicious: Column, challenger_issues: Column) -> Column:
    """Struct of status, value and outcome for a brand (struct of status, value) and a challenger; the first rule that holds decides."""
    b, c = base, challenger
    same = comparison_normalize(b["value"]).eqNullSafe(comparison_normalize(c["value"]))
    bt, ct = tokens(F.lower(b["value"])), tokens(F.lower(c["value"]))
    longer_head = (F.element_at(bt, -1) == F.element_at(ct, -1)) & (F.length(F.get(ct, 0)) > F.length(F.get(bt, 0)))
    out = lambda status, value, outcome: F.struct(status.alias("status"), value.alias("value"), F.lit(outcome).alias("outcome"))
    unsure, found = F.lit("UNCERTAIN"), F.lit("FOUND")
    weak = b["status"].isin("NOT_FOUND", "UNCERTAIN")
    return (
        F.when(c["status"] == "NOT_FOUND", out(b["status"], b["value"], "no_text"))
        .when((b["status"] == "FOUND") & (c["status"] == "UNCERTAIN") & ~suspicious, out(b["status"], b["value"], "uncertain_kept_base"))
        .when((b["status"] == "FOUND") & (c["status"] == "UNCERTAIN"), out(unsure, b["value"], "conflict_uncertain"))
        .when((b["status"] == "UNCERTAIN") & (c["status"] == "FOUND") & (F.size(ct) < 2), out(unsure, c["value"], "partial_uncertain"))
        .when(weak & (c["status"] == "FOUND"), out(found, c["value"], "replaced_weaker_base"))
        .when(weak & (F.coalesce(b["value"], F.lit("")) == ""), out(c["status"], c["value"], "filled_empty_base"))
        .when(weak & same, out(b["status"], b["value"], "reinforced_uncertain"))
        .when(weak, out(unsure, b["value"], "conflict_uncertain"))
        .when(same, out(found, b["value"], "reinforced"))
        .when((challenger_issues == 0) & suspicious & ((F.length(c["value"]) >= F.length(b["value"])) | F.coalesce(longer_head, F.lit(False))), out(found, c["value"], "superseded_weaker"))
        .otherwise(out(unsure, b["value"], "conflict_uncertain"))
    )


def escalate(base: DataFrame, region: DataFrame, whole: DataFrame) -> DataFrame:
    """Brands after a region pass, and after a whole pass only where the region left them undecided.

    Each frame has item_id, status, value; base also ``reasons`` (why it needs a
    look), ``suspicious`` and ``issues``.  Items without reasons skip both passes.
    """
    needs = base.where(F.size("reasons") > 0)
    skipped = base.where(F.size("reasons") == 0).select("item_id", "status", "value", F.lit("skipped").alias("outcome"))

    def step(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        o = other.select("item_id", F.struct("status", "value").alias("c"), F.coalesce("issues", F.lit(0)).alias("ci"))
        done = reconcile_brand(F.struct("status", "value"), F.coalesce("c", F.struct(F.lit("NOT_FOUND").alias("status"), F.lit(None).cast("string").alias("value"))), F.col("suspicious"), F.coalesce("ci", F.lit(0)))
        return df.join(o, "item_id", "left").select("item_id", "suspicious", done.alias("r")).select("item_id", "suspicious", "r.status", "r.value", F.concat(F.lit(name), F.col("r.outcome")).alias("outcome"))

    first = step(needs, region, "region_")
    solved = first.where("status = 'FOUND'").select("item_id", "status", "value", "outcome")
    second = step(first.where("status <> 'FOUND'"), whole, "whole_").select("item_id", "status", "value", "outcome")
    return skipped.unionByName(solved).unionByName(second)


def reinforcing(field_name: Column, raw: Column, value: Column, said: Column) -> Column:
    """Whether evidence elaborates the field without contradicting it."""
    return evidence.reinforces(field_name, *map(evidence.reading, (raw, value, said)))


def eligible_reason(status: Column, reason: Column, underlying: Column, check_name: Column, extraction_status: Column) -> Column:
    """The reason for which a reviewed check may ask for evidence; null if it may not."""
    masked = F.when(extraction_status == "UNCERTAIN", "EXTRACTION_UNCERTAIN").when(extraction_status == "NOT_FOUND", F.when(check_name == CHECKS[4], "WARNING_MISSING").otherwise("EXTRACTION_NOT_FOUND"))
    return F.when((status == "REVIEW") & ~F.coalesce(reason.isin(*HUMAN_ONLY_REASONS), F.lit(False)), F.when(reason.isin(*ELIGIBLE_REASONS), reason).when(underlying.isin(*ELIGIBLE_REASONS), underlying).when(reason == "OCR_LOW_QUALITY", masked))


#: What a provider is asked to do for each field, unless the caller says otherwise.
TASKS = {
    "brand_name": "Read the whole brand name printed on the label; the recognised text may lack words.",
    "class_type": "Read the designation of class and type as it is printed.",
    "alcohol_content": "Read the statement of alcohol by volume and, where there is one, of proof; work neither out from the other.",
    "net_contents": "Read quantity and unit of the net contents alone.",
    "government_warning": "Transcribe heading and text of the health warning as far as they can be read.",
}
ASKED = "struct<field:string,reason:string,task:string,ocr_text:string,candidates:array<string>,application_value:string,extraction_status:string,extraction_reason:string>"


def requests(checks: DataFrame, tasks: dict[str, str] | None = None) -> DataFrame:
    """One request for evidence per item under review: item_id, ``fields`` in the fixed order of checks, and quality.

    ``checks`` are those of ``rules.run`` with ``keep``.  An item asks only if its overall
    status is REVIEW, that is, if no check of it failed.  Status and requests come from one
    aggregate, and what a check asks is null unless it may ask, so texts of other
    checks aren't moved.  A check that repeats asks each time.  A check without an
    extracted field shows what it detected.
    """
    x = F.col("extracted")
    name = field_of(F.col("check_name"))
    why = eligible_reason(F.col("status"), F.col("reason_code"), F.col("underlying_reason_code"), F.col("check_name"), x["status"])
    may = F.col("check_name").isin(*CHECKS) & (F.col("ai_assist_eligible") | (F.col("reason_code") == "OCR_LOW_QUALITY")) & why.isNotNull()
    place = F.create_map(*(F.lit(v) for pair in zip(CHECKS, range(5), strict=True) for v in pair))[F.col("check_name")]
    task = F.create_map(*(F.lit(v) for pair in (tasks or TASKS).items() for v in pair))[name]
    shown = F.when(x.isNull(), F.col("detected_value")).otherwise(x["raw_text"])
    asked = F.struct(place.alias("at"), name.alias("field"), why.alias("reason"), task.alias("task"), shown.alias("ocr_text"), F.coalesce(x["candidates"], F.array().cast("array<string>")).alias("candidates"), F.col("app_value").alias("application_value"), x["status"].alias("extraction_status"), x["reason"].alias("extraction_reason"))
    grouped = checks.groupBy("item_id").agg(worst(F.collect_set("status")).alias("overall_status"), F.array_sort(F.collect_list(F.when(may, asked))).alias("asked"), F.max("quality").alias("quality"))
    bare = F.transform("asked", lambda a: a.dropFields("at")).cast(f"array<{ASKED}>")
    return grouped.where("overall_status = 'REVIEW' and size(asked) > 0").select("item_id", bare.alias("fields"), "quality")


def within_budget(requests: DataFrame, calls: int, key: str = "item_id") -> DataFrame:
    """Requests with ``granted``: the first ``calls`` in order of key get a call, the others none.

    The order is found by a bounded top-k, so no task sees all requests.  Of
    requests that share a key, which may be cut by the budget, any may be first.
    """
    first = requests.select(key).orderBy(key).limit(calls).groupBy(key).agg(F.count("*").alias("calls"))
    own = F.row_number().over(Window.partitionBy(key).orderBy(key))
    met = requests.join(F.broadcast(first), key, "left_semi").withColumn("at", own).join(F.broadcast(first), key)
    rest = requests.join(F.broadcast(first), key, "left_anti").withColumn("granted", F.lit(False))
    return met.withColumn("granted", F.col("at") <= F.col("calls")).select(*requests.columns, "granted").unionByName(rest)


#: Answers that a script has at most; they become part of the plan.
SCRIPT_ROWS = 1_000


def scripted_evidence(requests: DataFrame, script: DataFrame) -> DataFrame:
    """Answers that a script (field_name and the answer's columns) gives to requests (item_id, fields): those on requested fields, or, for an item on none of whose fields the script has any, all of them.

    A script is a fixture; one of more than ``SCRIPT_ROWS`` answers is refused.
    """
    said = script.limit(SCRIPT_ROWS + 1).collect()
    if len(said) > SCRIPT_ROWS:
        raise ValueError(f"a script has at most {SCRIPT_ROWS} answers")
    kind = script.schema.simpleString()
    answers = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in row.asDict().items())) for row in said)).cast(f"array<{kind}>")
    met = F.filter(answers, lambda a: F.exists("fields", lambda f: f["field"] == a["field_name"]))
    told = requests.select("item_id", F.explode(F.when(F.size(met) > 0, met).otherwise(answers)).alias("a"))
    return told.select("item_id", "a.*")


def no_evidence(requests: DataFrame, reason: str) -> DataFrame:
    """What is recorded where no provider is asked: no answers, and why."""
    said = F.concat(F.lit("evidence recovery skipped ("), F.size("fields").cast("string"), F.lit(f" field(s)). {reason}"))
    return requests.select("item_id", F.lit(False).alias("called"), said.alias("explanation"))


def budget_reason(reasons: Column, outcome: Column) -> Column:
    """Reasons with AI_BUDGET_EXHAUSTED once, where no call was left."""
    return F.when(outcome == "provider_unavailable", F.array_union(reasons, F.array(F.lit("AI_BUDGET_EXHAUSTED")))).otherwise(reasons)


def ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their number within a key."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
