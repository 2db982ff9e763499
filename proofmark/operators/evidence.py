"""Outside evidence on fields: what an answer is worth, and what a sequence of answers makes of a field.

Answers on one field are merged in their order, each against what the ones before
made of it.  What comparisons look at (keys, parsed statements) is worked out for
every text before; a field's answers are then folded by ``aggregate``, so nothing
but plain expressions runs within, and a field needs no more than its own answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions import parse
from proofmark.functions.similarity import keys_agree, right_preferred
from proofmark.functions.text import comparison_normalize, let, nonempty, strip

KEYS = ["item_id", "field_name"]
#: Outcomes that change a field; others are rejections, or leave it as it was.
CHANGING = ("supplemented", "filled", "conflict")
HEADING = "GOVERNMENT WARNING"


def reading(text: Column) -> Column:
    """A text with its key, its alcohol statement and its quantity."""
    return F.struct(text.alias("text"), comparison_normalize(text).alias("key"), parse.alcohol(text).alias("a"), parse.net(text).alias("n"))


def _unkeyed(text: Column) -> Column:
    """A reading of alcohol, quantity or heading, whose key is never looked at."""
    return F.struct(text.alias("text"), F.lit(None).cast("string").alias("key"), parse.alcohol(text).alias("a"), parse.net(text).alias("n"))


def _first(a: Column, b: Column) -> Column:
    """The first reading that has a text."""
    return F.when(nonempty(a["text"]).isNotNull(), a).otherwise(b)


def _ml(r: Column) -> Column:
    return parse.to_ml(r["n"]["value"], r["n"]["unit"])


def reinforces(field_name: Column, raw: Column, value: Column, said: Column) -> Column:
    """Whether an answer elaborates a field without contradicting it (all but the name are readings)."""
    ocr = _first(raw, value)
    l, r = ocr["a"], said["a"]  # noqa: E741
    proof = (l["source"] == "proof") & r["source"].isin("abv", "both")
    abv = F.when(proof, ~F.coalesce(F.abs(r["proof"] - l["proof"]) > 0.6, F.lit(False)) & (F.abs(r["abv"] - l["proof"] / 2) <= 0.6)).otherwise(F.abs(l["abv"] - r["abv"]) <= 0.5)
    ml = F.abs(F.coalesce(_ml(ocr), _ml(value)) - _ml(said)) <= 0.5
    told = F.when(field_name == "alcohol_content", abv).when(field_name == "net_contents", ml).otherwise(keys_agree(ocr["key"], said["key"]))
    return F.coalesce((strip(ocr["text"]) != "") & (said["text"] != "") & told, F.lit(False))


def contradicts(field_name: Column, raw: Column, value: Column, said: Column) -> Column:
    """Whether an answer that doesn't reinforce a field states something else."""
    ocr = _first(raw, value)
    abv = F.abs(ocr["a"]["abv"] - said["a"]["abv"]) > 0.5
    ml = F.abs(_ml(_first(value, raw)) - _ml(said)) > 0.5
    named = ocr["key"].isNotNull() & said["key"].isNotNull() & ~keys_agree(ocr["key"], said["key"])
    return F.coalesce(F.when(field_name == "alcohol_content", abv).when(field_name == "net_contents", ml).otherwise(named), F.lit(False))


def problem(field_name: Column, candidate: Column, observed: Column, confidence: Column, unable: Column) -> Column:
    """Why an answer is rejected; null if it is usable."""
    text = strip(F.coalesce(parse.first_of(candidate, observed), F.lit("")))
    a = parse.alcohol(text)
    return (
        F.when(F.coalesce(unable, F.lit(False)), "unable_to_determine")
        .when(parse.first_of(candidate, observed).isNull(), "empty_candidate")
        .when(F.coalesce(confidence, F.lit("LOW")) == "LOW", "low_confidence")
        .when(text == "", "empty_text")
        .when((field_name == "alcohol_content") & (a["abv"].isNull() | (a["source"] == "proof")), "abv_unparseable")
        .when((field_name == "net_contents") & parse.net(text).isNull(), "net_contents_unparseable")
    )


def answers(evidence: DataFrame) -> DataFrame:
    """Per item and field its answers in order (``at``, then text): an array of what each says and whether it is usable."""
    name = F.col("field_name")
    order = F.col("at") if "at" in evidence.columns else F.lit(0)
    text = strip(F.coalesce(parse.first_of(F.col("candidate_value"), F.col("raw_observed_text")), F.lit("")))
    bad = problem(name, F.col("candidate_value"), F.col("raw_observed_text"), F.col("confidence"), F.col("unable_to_determine"))
    read = evidence.select(*KEYS, order.alias("at"), "confidence", bad.alias("problem"), text.alias("text")).withColumn("said", reading(F.col("text")))
    a, n = F.col("said.a"), F.col("said.n")
    shown = F.when(name == "alcohol_content", parse.alcohol_display(a)).when(name == "net_contents", n["display"]).when(name == "government_warning", HEADING)
    span = F.when((name == "alcohol_content") & (a["source"] == "abv"), a["abv_span"])
    one = F.struct("at", "text", "confidence", "problem", "said", _unkeyed(F.coalesce(span, F.col("text"))).alias("span"), _unkeyed(F.coalesce(shown, F.col("text"))).alias("shown"))
    return read.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("answers"))


def _judged(name: Column, s: Column, e: Column) -> Column:
    """State and answer with whether they agree and what becomes of the answer."""
    agrees, differs = reinforces(name, s["raw"], s["value"], e["said"]), contradicts(name, s["raw"], s["value"], e["said"])

    def outcome(x: Column) -> Column:
        usable = (
            F.when(~s["status"].isin("FOUND", "UNCERTAIN", "NOT_FOUND"), "skipped_status")
            .when(s["status"] == "FOUND", F.when(x["agrees"], "supplemented").when(x["differs"], "conflict").otherwise("kept_ocr"))
            .when((s["status"] == "UNCERTAIN") & nonempty(s["raw"]["text"]).isNotNull() & x["differs"] & ~x["agrees"], "conflict")
            .otherwise("filled")
        )
        return F.when(e["problem"].isNotNull(), F.concat(F.lit("rejected:"), e["problem"])).otherwise(usable)

    return let(F.struct(agrees.alias("agrees"), differs.alias("differs")), lambda x: F.struct(s.alias("s"), e.alias("e"), x["agrees"].alias("agrees"), outcome(x).alias("outcome")))


def _after(name: Column, j: Column) -> Column:
    """The state after an answer."""
    s, e, outcome = j["s"], j["e"], j["outcome"]
    used, supplemented, conflict = outcome.isin("supplemented", "filled"), outcome == "supplemented", outcome == "conflict"
    word = name.isin("brand_name", "class_type")
    alcohol, net = name == "alcohol_content", name == "net_contents"

    def preferred(left: Column) -> Column:
        keys = F.struct(left["key"].alias("left"), e["said"]["key"].alias("right"))
        return F.when(right_preferred(left["text"], e["said"]["text"], keys), e["said"]).otherwise(left)

    raw = F.when(word, preferred(s["raw"])).when(supplemented & alcohol, e["span"]).when(supplemented & net, _first(s["raw"], e["said"])).otherwise(e["said"])
    value = F.when(word, preferred(_first(s["value"], s["raw"]))).otherwise(e["shown"])
    number = F.when(alcohol, e["said"]["a"]["abv"]).when(net, e["said"]["n"]["value"])
    unit = F.when(alcohol, "%").when(net, e["said"]["n"]["unit"])
    sure = supplemented | (e["confidence"] == "HIGH") | ((e["confidence"] == "MEDIUM") & j["agrees"])
    seen = F.array_distinct(F.concat(s["candidates"], F.array(F.coalesce(s["raw"]["text"], F.lit("")), e["said"]["text"])))
    note = F.struct(s["raw"]["text"].alias("stated"), e["said"]["text"].alias("answer"))
    return F.struct(
        F.when(conflict, "UNCERTAIN").when(used, F.when(sure, "FOUND").otherwise("UNCERTAIN")).otherwise(s["status"]).alias("status"),
        F.when(used, raw).otherwise(s["raw"]).alias("raw"),
        F.when(used, value).otherwise(s["value"]).alias("value"),
        F.when(used, F.coalesce(number, s["number"])).otherwise(s["number"]).alias("number"),
        F.when(used, F.coalesce(unit, s["unit"])).otherwise(s["unit"]).alias("unit"),
        F.when(conflict | used, seen).otherwise(s["candidates"]).alias("candidates"),
        F.when(conflict, "CONFLICTING_EVIDENCE").otherwise(s["reason"]).alias("reason"),
        F.when(used & alcohol, e["said"]["a"]["source"]).otherwise(s["source"]).alias("source"),
        F.concat(s["outcomes"], F.array(outcome)).alias("outcomes"),
        F.when(conflict, F.concat(s["conflicts"], F.array(note))).otherwise(s["conflicts"]).alias("conflicts"),
    )


def merge(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """Fields in long form after all evidence on them, answer by answer.

    ``evidence`` has item_id, field_name, candidate_value, raw_observed_text,
    confidence, unable_to_determine and, where a field has several answers,
    ``at``, their order.  One row per field, with ``outcomes`` (one per answer),
    ``outcome`` (the last one, null without an answer), ``updated`` (whether any answer
    changed it) and ``conflicts``; one row of rejections for each field that an item lacks.
    A conflict leaves the field uncertain; a later answer may settle it.
    """
    name = F.col("field_name")
    text = lambda x: x.cast("string")
    none = F.array().cast("array<string>")
    start = F.struct(
        F.col("status").alias("status"),
        F.col("raw").alias("raw"),
        F.col("value").alias("value"),
        F.col("normalized_numeric").cast("double").alias("number"),
        text(F.col("normalized_unit")).alias("unit"),
        F.coalesce("candidates", none).alias("candidates"),
        text(F.col("reason")).alias("reason"),
        text(F.col("source")).alias("source"),
        none.alias("outcomes"),
        F.array().cast("array<struct<stated:string,answer:string>>").alias("conflicts"),
    )
    told = answers(evidence)
    known = fields.withColumns({"raw": reading(F.col("raw_text")), "value": reading(F.col("normalized_value"))}).select(*KEYS, start.alias("start"))
    joined = known.join(told, KEYS, "full")
    folded = F.aggregate("answers", F.col("start"), lambda s, e: let(_judged(name, s, e), lambda j: _after(name, j)))
    refused = F.transform("answers", lambda e: F.concat(F.lit("rejected:"), F.coalesce(e["problem"], F.lit("unknown_field"))))
    done = joined.select(*KEYS, F.col("start").isNull().alias("unknown"), refused.alias("refused"), F.when(F.col("start").isNotNull() & F.col("answers").isNotNull(), folded).otherwise(F.col("start")).alias("s"))
    outcomes = F.when(F.col("unknown"), F.col("refused")).otherwise(F.col("s.outcomes"))
    done = done.withColumn("outcomes", outcomes)
    return done.select(
        *KEYS,
        "s.status",
        F.col("s.raw.text").alias("raw_text"),
        F.col("s.value.text").alias("normalized_value"),
        F.col("s.number").alias("normalized_numeric"),
        F.col("s.unit").alias("normalized_unit"),
        "s.candidates",
        "s.reason",
        "s.source",
        "outcomes",
        F.when(F.size("outcomes") > 0, F.element_at("outcomes", -1)).alias("outcome"),
        F.exists("outcomes", lambda x: x.isin(*CHANGING)).alias("updated"),
        "s.conflicts",
    )


def by_item(merged: DataFrame) -> DataFrame:
    """Per item with any answer: ``fields_updated`` (sorted), ``merge_outcomes`` (a map from fields to their last outcome) and ``conflicted``."""
    return (
        merged.where(F.size("outcomes") > 0)
        .groupBy("item_id")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("updated"), F.col("field_name")))).alias("fields_updated"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "outcome")))).alias("merge_outcomes"),
            F.bool_or(F.col("outcome") == "conflict").alias("conflicted"),
        )
    )


def assistance(items: DataFrame, merged: DataFrame) -> DataFrame:
    """Per item how evidence came about: what ``rules.annotate`` takes.

    ``items`` has item_id, status_before, eligible, configured, available (whether the
    provider was), called, answered (whether it gave a result), raised (whether it broke off with an
    error), method (how recognition alone came by its evidence) and, where brands were looked at again, brand_escalation.
    """
    done = items.join(by_item(merged), "item_id", "left")
    fields_updated = F.coalesce("fields_updated", F.array().cast("array<string>"))
    changed = F.size(fields_updated) > 0
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    asked = yes("eligible")
    outcome = (
        F.when(asked & ~yes("available"), "provider_unavailable")
        .when(asked & yes("raised"), "provider_exception")
        .when(asked & ~yes("called"), "provider_not_called")
        .when(asked & ~yes("answered"), "provider_failed")
        .when(asked & changed, "evidence_merged")
        .when(asked, "no_usable_evidence")
        .when(F.col("status_before") == "PASS", "not_needed_pass")
        .when(F.col("status_before") == "FAIL", "not_needed_fail")
        .otherwise("not_eligible")
    )
    failure = F.when(F.col("outcome") == "provider_not_called", "not_called").when(F.col("outcome").isin("provider_unavailable", "provider_exception", "provider_failed", "no_usable_evidence"), F.col("outcome"))
    suffix = F.when(F.col("outcome").isin("provider_unavailable", "provider_not_called"), "_ai_unavailable").when(F.col("outcome").isin("provider_exception", "provider_failed"), "_ai_failed").when(F.col("outcome") == "no_usable_evidence", "_ai_rejected").otherwise("")
    merged_method = F.when(F.col("conflicted"), "ocr_plus_ai_conflict").otherwise("ocr_plus_ai")
    succeeded = F.col("outcome") == "evidence_merged"
    kept = ["brand_escalation"] if "brand_escalation" in items.columns else []
    return done.withColumns({"attempted": asked, "outcome": outcome}).select(
        "item_id",
        F.when(succeeded, merged_method).otherwise(F.concat("method", suffix)).alias("evidence_method"),
        "outcome",
        yes("configured").alias("configured"),
        asked.alias("eligible"),
        "attempted",
        succeeded.alias("succeeded"),
        failure.alias("failure_category"),
        F.when(succeeded, fields_updated).otherwise(F.array().cast("array<string>")).alias("fields_updated"),
        "merge_outcomes",
        *kept,
    )
