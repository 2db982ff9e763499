"""The rules: one check per field, as decision ladders over columns.

A rule takes the application's value, the extracted field (struct, null if there
is none), the image quality and the thresholds, and gives a struct of status,
reason_code, decision_method, ai_assist_eligible and similarity.  A rule is any
function of that shape; ``run`` takes them by field, so callers can add theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.config import CHECKS, CITATIONS, DEFAULT, FIELDS, STATUTORY_WARNING, Settings
from proofmark.functions import parse
from proofmark.functions.similarity import category_conflict, text_similarity, token_set_ratio
from proofmark.functions.text import comparison_normalize, nonempty, warning_normalize

Rule = Callable[[Column, Column, Column, Settings], Column]
PASS_REASON = {"brand_name": "BRAND_MATCH", "class_type": "CLASS_TYPE_MATCH", "alcohol_content": "ABV_MATCH", "net_contents": "NET_CONTENTS_MATCH", "government_warning": "WARNING_WORDING_MATCH"}
SOURCES = {"brand_name": ("cfr_5_63", "cfr_5_64"), "class_type": ("cfr_5_63", "cfr_5_subpart_i"), "alcohol_content": ("cfr_5_63", "cfr_5_65"), "net_contents": ("cfr_5_63", "cfr_5_70"), "government_warning": ("cfr_16_21", "cfr_16_22")}


def result(status: str, reason: str | Column, method: str = "DETERMINISTIC_RULE", eligible: bool = False, similarity: Column | None = None, underlying: str | Column | None = None) -> Column:
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    return F.struct(F.lit(status).alias("status"), text(reason).alias("reason_code"), F.lit(method).alias("decision_method"), F.lit(eligible).alias("ai_assist_eligible"), (F.lit(None) if similarity is None else similarity).cast("double").alias("similarity"), text(underlying).alias("underlying_reason_code"))


def detected(f: Column) -> Column:
    """What is shown for a field: the normalised value, else the raw text."""
    return F.coalesce(nonempty(f["normalized_value"]), f["raw_text"])


def evidence(f: Column) -> Column:
    """Raw and normalised text together."""
    return F.concat_ws(" ", nonempty(f["raw_text"]), nonempty(f["normalized_value"]))


def gate(f: Column, quality: Column, missing: str = "EXTRACTION_NOT_FOUND") -> Column:
    """A review for a field that is missing, uncertain or not found; null lets the rule go on.

    Poor quality masks a plain uncertainty and any absence; the reason beneath stays.
    """
    poor = F.coalesce(quality.isin("WARNING", "POOR"), F.lit(False))
    unsure = F.when(f["reason"].isin("CONFLICTING_EVIDENCE", "brand_ocr_conflict"), "CONFLICTING_EVIDENCE").when(f["reason"] == "brand_ambiguous", "BRAND_AMBIGUOUS").otherwise("EXTRACTION_UNCERTAIN")
    shown = F.when(poor & (unsure == "EXTRACTION_UNCERTAIN"), "OCR_LOW_QUALITY").otherwise(unsure)
    human = "HUMAN_REVIEW_REQUIRED"
    return (
        F.when(f.isNull(), result("REVIEW", "EXTRACTION_NOT_FOUND", human, True))
        .when(f["status"] == "UNCERTAIN", result("REVIEW", shown, human, True, underlying=unsure))
        .when(f["status"] == "NOT_FOUND", result("REVIEW", F.when(poor, "OCR_LOW_QUALITY").otherwise(missing), human, True, underlying=missing))
    )


def brand(app: Column, f: Column, quality: Column, s: Settings = DEFAULT) -> Column:
    ratio = text_similarity(app, detected(f))
    exact = comparison_normalize(app) == comparison_normalize(detected(f))
    decided = F.when(exact, result("PASS", "BRAND_MATCH", "NORMALIZED_MATCH", similarity=ratio)).when(ratio >= s.brand_pass, result("PASS", "BRAND_MATCH", "FUZZY_MATCH", similarity=ratio))
    decided = decided.when(ratio >= s.brand_review, result("REVIEW", "BRAND_AMBIGUOUS", "FUZZY_MATCH", True, ratio)).otherwise(result("FAIL", "BRAND_MISMATCH", "FUZZY_MATCH", similarity=ratio))
    return F.coalesce(gate(f, quality), decided)


def class_type(app: Column, f: Column, quality: Column, s: Settings = DEFAULT) -> Column:
    a, b = comparison_normalize(app), comparison_normalize(detected(f))
    ratio = text_similarity(app, detected(f))
    apart = F.coalesce(category_conflict(a, b), F.lit(False)) & (ratio < s.class_conflict)
    decided = F.when(a == b, result("PASS", "CLASS_TYPE_MATCH", "NORMALIZED_MATCH", similarity=ratio)).when(ratio >= s.class_pass, result("PASS", "CLASS_TYPE_MATCH", "FUZZY_MATCH", similarity=ratio))
    decided = decided.when(apart, result("FAIL", "CLASS_TYPE_MISMATCH", "FUZZY_MATCH", similarity=ratio)).otherwise(result("REVIEW", "CLASS_TYPE_AMBIGUOUS", "FUZZY_MATCH", True, ratio))
    return F.coalesce(gate(f, quality), decided)


def alcohol(app: Column, f: Column, quality: Column, s: Settings = DEFAULT) -> Column:
    wanted = parse.application_abv(app)
    proof_only = (f["source"] == "proof") | parse.alcohol(evidence(f))["source"].eqNullSafe("proof")
    decided = (
        F.when(wanted.isNull(), result("REVIEW", "APPLICATION_VALUE_INVALID", "HUMAN_REVIEW_REQUIRED"))
        .when(f["normalized_numeric"].isNull(), result("REVIEW", "EXTRACTION_UNCERTAIN", "HUMAN_REVIEW_REQUIRED", True))
        .when(~parse.authorized_abv(evidence(f)), F.when(proof_only, result("REVIEW", "PROOF_ONLY_NO_PERCENT_STATEMENT", eligible=True)).otherwise(result("REVIEW", "ABV_FORMAT_REVIEW", eligible=True)))
        .when(parse.within(wanted, f["normalized_numeric"], s.abv_epsilon), result("PASS", "ABV_MATCH"))
        .otherwise(result("FAIL", "ABV_MISMATCH"))
    )
    return F.coalesce(gate(f, quality), decided)


def net(app: Column, f: Column, quality: Column, s: Settings = DEFAULT) -> Column:
    wanted = parse.application_net_ml(app)
    label = F.coalesce(parse.to_ml(f["normalized_numeric"], f["normalized_unit"]), parse.application_net_ml(detected(f)))
    decided = (
        F.when(wanted.isNull(), result("REVIEW", "APPLICATION_VALUE_INVALID", "HUMAN_REVIEW_REQUIRED"))
        .when(label.isNull(), result("REVIEW", "EXTRACTION_UNCERTAIN", "HUMAN_REVIEW_REQUIRED", True))
        .when(parse.within(wanted, label, s.net_epsilon_ml), result("PASS", "NET_CONTENTS_MATCH"))
        .otherwise(result("FAIL", "NET_CONTENTS_MISMATCH"))
    )
    return F.coalesce(gate(f, quality), decided)


def warning(app: Column, f: Column, quality: Column, s: Settings = DEFAULT) -> Column:
    """Wording against the statute, then the heading's capitals; the same with and without an application."""
    poor = F.coalesce(quality.isin("WARNING", "POOR"), F.lit(False))
    missing = F.when(poor, "OCR_LOW_QUALITY").otherwise("WARNING_MISSING")
    ratio = token_set_ratio(F.lit(STATUTORY_WARNING.lower()), warning_normalize(f["raw_text"]))
    upper = parse.heading_is_upper(f["raw_text"])
    human = "HUMAN_REVIEW_REQUIRED"
    return (
        F.when(f.isNull() | (f["status"] == "NOT_FOUND"), result("REVIEW", missing, human, True, underlying="WARNING_MISSING"))
        .when(f["status"] == "UNCERTAIN", result("REVIEW", "WARNING_PARTIAL", human, True))
        .when(ratio < s.warning_fail, result("FAIL", "WARNING_WORDING_MISMATCH", "FUZZY_MATCH", similarity=ratio))
        .when(ratio < s.warning_pass, result("REVIEW", "WARNING_PARTIAL", "FUZZY_MATCH", True, ratio))
        .when(upper, result("PASS", "WARNING_WORDING_MATCH", similarity=ratio))
        .otherwise(result("REVIEW", "WARNING_CAPS_REVIEW", human, similarity=ratio))
    )


def present(name: str) -> Rule:
    """Without an application: a found field passes, except alcohol without a stated percentage."""

    def rule(app: Column, f: Column, quality: Column, s: Settings = DEFAULT) -> Column:
        decided = result("PASS", PASS_REASON[name])
        if name == "alcohol_content":
            proof_only = (f["source"] == "proof") | parse.alcohol(evidence(f))["source"].eqNullSafe("proof")
            decided = F.when(parse.authorized_abv(evidence(f)), decided).when(proof_only, result("REVIEW", "PROOF_ONLY_NO_PERCENT_STATEMENT", eligible=True)).otherwise(result("REVIEW", "ABV_FORMAT_REVIEW", eligible=True))
        return F.coalesce(gate(f, quality), decided)

    return rule


COMPARISON: dict[str, Rule] = {"brand_name": brand, "class_type": class_type, "alcohol_content": alcohol, "net_contents": net, "government_warning": warning}
LABEL_ONLY: dict[str, Rule] = {name: present(name) for name in FIELDS[:4]} | {"government_warning": warning}


def mode(has_application: Column) -> Column:
    return F.when(has_application, "COMPARISON").otherwise("LABEL_ONLY")


def rules_of(comparison: bool) -> dict[str, Rule]:
    return COMPARISON if comparison else LABEL_ONLY


def run(fields: DataFrame, rules: dict[str, Rule] | None = None, settings: Settings = DEFAULT, keep: bool = False) -> DataFrame:
    """Checks of fields in long form (field_name, app_value, quality and the field's columns); each row gets its rule's result.

    ``keep`` leaves app_value, quality and the field itself, as the struct ``extracted``, with each check.
    """
    f = F.struct("status", "raw_text", "normalized_value", "normalized_numeric", "normalized_unit", "candidates", "reason", "source")
    f = F.when(F.col("status").isNotNull(), f)
    chosen, names = None, dict(zip(FIELDS, CHECKS, strict=True))
    for name, rule in (rules or COMPARISON).items():
        mine = F.col("field_name") == name
        # Python functions run for all rows, whatever stands round them: those of other fields are null to them.
        done = rule(F.when(mine, F.col("app_value")), F.when(mine, f), F.col("quality"), settings)
        chosen = F.when(mine, done) if chosen is None else chosen.when(mine, done)
    check = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("field_name")]
    kept = [c for c in fields.columns if c not in ("status", "raw_text", "normalized_value", "normalized_numeric", "normalized_unit", "candidates", "reason", "source", "app_value", "quality")]
    more = ["app_value", "quality", "extracted"] if keep else []
    judged = fields.withColumn("extracted", f) if keep else fields
    return judged.select(*kept, *more, check.alias("check_name"), detected(f).alias("detected_value"), chosen.alias("r")).select(*kept, *more, "check_name", "detected_value", "r.*")


def citations(field_name: Column) -> Column:
    """The citations that a field's check rests on."""
    pairs = [x for name, keys in SOURCES.items() for x in (F.lit(name), F.array(*(F.lit(CITATIONS[k]) for k in keys)))]
    return F.create_map(*pairs)[field_name]


def worst(statuses: Column) -> Column:
    """FAIL over REVIEW over PASS; PASS for none."""
    return F.when(F.array_contains(statuses, "FAIL"), "FAIL").when(F.array_contains(statuses, "REVIEW"), "REVIEW").otherwise("PASS")


def stub(items: DataFrame) -> DataFrame:
    """Five reviews per item, for a pipeline without recognition."""
    return items.select("*", F.explode(F.array(*map(F.lit, CHECKS))).alias("check_name")).withColumns({"status": F.lit("REVIEW"), "reason_code": F.lit("PIPELINE_STUB")})


def field_of(check_name: Column) -> Column:
    """The field that a check judges."""
    return F.create_map(*(F.lit(x) for pair in zip(CHECKS, FIELDS, strict=True) for x in pair))[check_name]


#: Fixed value: what an explanation says where other evidence was weighed.
CONSIDERED = " (AI-assisted evidence was considered; status is deterministic.)"


def annotate(checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Checks (item_id, check_name, explanation) with how their item's evidence came about.

    ``evidence`` has one row per item, as ``evidence.assistance`` gives it: how evidence
    came about, the fields that answers changed, and the last outcome of each field.  A check whose
    field changed is marked as assisted and its explanation says so; fields whose answers were rejected or
    left them as they were are not.  The brand's check takes the detail of its second look, where there is one.  Items without a row stay unmarked.
    """
    e = F.col("e")
    name = field_of(F.col("check_name"))
    changed = F.coalesce(F.array_contains(e["fields_updated"], name), F.lit(False))
    failed = F.coalesce(e["attempted"] & ~e["succeeded"] & (e["failure_category"] != ""), F.lit(False))
    joined = checks.join(evidence.select("item_id", F.struct(*(c for c in evidence.columns if c != "item_id")).alias("e")), "item_id", "left")
    detail = {"brand_escalation": F.when(F.col("check_name") == CHECKS[0], e["brand_escalation"])} if "brand_escalation" in evidence.columns else {}
    return joined.withColumns(
        {
            "evidence_method": e["evidence_method"],
            "ai_assist_outcome": e["outcome"],
            "ai_configured": e["configured"],
            "ai_eligible_for_review": e["eligible"],
            "ai_assisted_evidence": F.when(changed, True),
            "ai_merge_outcome": F.when(changed, e["merge_outcomes"][name]),
            "ai_attempted_but_unavailable": F.when(failed, True),
            "ai_failure_category": F.when(failed, e["failure_category"]),
            "explanation": F.concat("explanation", F.when(changed, CONSIDERED).otherwise("")),
            **detail,
        }
    ).drop("e")


def evidence_method(enhanced: Column, region: Column, outcome: Column) -> Column:
    """How a check's evidence came about."""
    return (
        F.when(outcome.isin("filled", "supplemented"), "ocr_plus_ai")
        .when(outcome == "conflict", "ocr_plus_ai_conflict")
        .when(outcome == "provider_unavailable", "ocr_plus_ai_unavailable")
        .when(region & enhanced, "ocr_plus_enhanced_plus_brand_region")
        .when(region, "ocr_plus_brand_region")
        .when(enhanced, "ocr_plus_enhanced")
        .otherwise("ocr_only")
    )
