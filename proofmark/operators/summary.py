"""Severity, batch counts, timings, rankings and filters over items and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.operators.ranks import nearest_rank  # noqa: F401  part of what batches are summed up by
from proofmark.operators.rules import worst


def items(checks: DataFrame, *keys: str) -> DataFrame:
    """Per item: overall status, counts by status, and the reasons of reviewed checks in the order of checks (``field_at``)."""
    reason = F.when(F.col("status") == "REVIEW", F.struct("field_at", "reason_code"))
    counted = {s: F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in ("PASS", "REVIEW", "FAIL")}
    grouped = checks.groupBy(*keys).agg(worst(F.collect_set("status")).alias("overall_status"), *counted.values(), F.array_sort(F.collect_list(reason)).alias("r"))
    return grouped.withColumn("review_reason_codes", F.array_join(F.transform("r", lambda x: x["reason_code"]), ";")).drop("r")


def batch(batch_items: DataFrame, *keys: str) -> DataFrame:
    """Counts by state, by outcome (of completed items only), and of assisted items."""
    done = F.col("processing_state") == "COMPLETED"
    n = lambda c, name: F.count_if(c).alias(name)
    return batch_items.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *(n(F.col("processing_state") == s, s.lower()) for s in ("QUEUED", "PROCESSING", "ERROR", "COMPLETED")),
        *(n(done & (F.col("overall_status") == s), f"{s.lower()}_count") for s in ("PASS", "REVIEW", "FAIL")),
        n(done & F.col("ai_assisted"), "ai_assisted"),
        n(F.col("ai_assisted"), "ai_assisted_all"),
    )


def median(c: str) -> Column:
    return F.percentile(c, 0.5)


def attention(c_state: Column, c_status: Column) -> Column:
    """Order of urgency: errors, failures, reviews, the rest."""
    return F.when(c_state == "ERROR", 0).when(c_status == "FAIL", 1).when(c_status == "REVIEW", 2).otherwise(3)


def matches(choice: str, state: Column, status: Column) -> Column:
    """The filter of that name: PASS, REVIEW, FAIL, ERROR, attention, or all."""
    if choice in ("PASS", "REVIEW", "FAIL"):
        return F.coalesce(status == choice, F.lit(False))
    if choice == "ERROR":
        return state == "ERROR"
    if choice == "attention":
        return (state == "ERROR") | F.coalesce(status.isin("REVIEW", "FAIL"), F.lit(False))
    return F.lit(True)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """The rows with these values; a filter that reaches the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """How often each combination of values occurs."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def search(term: str, *columns: Column) -> Column:
    """Whether any of the columns holds the term, in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(term.strip().lower()), F.lit(False))
    return found
