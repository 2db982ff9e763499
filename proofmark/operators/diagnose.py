"""Where values go on their way: the state of every field at every stage, and the first stage that lost it.

Stages are frames of fields in long form (item_id, field_name, status, raw_text,
normalized_value), in the order in which they run.  A stage that has no row for a
field did not run for it.  A stage holds a value if the field is found or uncertain and
shows some text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.functions.text import nonempty, strip
from proofmark.operators.evidence import KEYS

STATE = "struct<held:boolean,shown:string,first_at:string,lost_at:string,lost:string,regained_at:string,changed_at:string,last_status:string>"


def states(stages: dict[str, DataFrame]) -> DataFrame:
    """Per item and field the stages that ran, in order: place, stage, status, what was shown, and whether a value was held."""
    shown = F.coalesce(nonempty(strip(F.col("normalized_value"))), nonempty(strip(F.col("raw_text"))))
    held = F.coalesce(F.col("status").isin("FOUND", "UNCERTAIN"), F.lit(False)) & shown.isNotNull()
    one = lambda at, name: F.struct(F.lit(at).alias("place"), F.lit(name).alias("stage"), F.col("status").alias("status"), shown.alias("shown"), held.alias("held"))
    every = reduce(DataFrame.unionByName, (df.select(*KEYS, one(at, name).alias("state")) for at, (name, df) in enumerate(stages.items())))
    return every.groupBy(*KEYS).agg(F.array_sort(F.collect_list("state")).alias("states"))


def _step(s: Column, x: Column) -> Column:
    """What is known after one more stage."""
    goes, comes = s["held"] & ~x["held"], x["held"] & ~s["held"]
    differs = x["held"] & s["shown"].isNotNull() & (F.lower(x["shown"]) != F.lower(s["shown"]))
    keep = lambda name, value: F.coalesce(s[name], value).alias(name)
    return F.struct(
        x["held"].alias("held"),
        F.when(x["held"], x["shown"]).otherwise(s["shown"]).alias("shown"),
        keep("first_at", F.when(x["held"], x["stage"])),
        keep("lost_at", F.when(goes, x["stage"])),
        keep("lost", F.when(goes, s["shown"])),
        keep("regained_at", F.when(comes & s["lost_at"].isNotNull(), x["stage"])),
        keep("changed_at", F.when(differs, x["stage"])),
        x["status"].alias("last_status"),
    )


def losses(stages: dict[str, DataFrame], checks: DataFrame | None = None) -> DataFrame:
    """Per item and field what became of its value.

    ``first_at`` is the first stage that held a value; ``lost_at`` the earliest that no
    longer did though the one before it had, with the value that was ``lost``; ``regained_at`` the first after that to
    hold one; ``changed_at`` the first that held another value than the last one held, case
    aside.  ``outcome``: never (no stage held one), lost (the last doesn't), regained, late (the
    first stage had none), changed, or kept.  ``checks`` (item_id, field_name, status, reason_code)
    add the final rule's status and reason; a field without a check has none.
    """
    told = F.aggregate("states", F.from_json(F.lit('{"held": false}'), STATE), _step)
    done = states(stages).withColumn("s", told)
    outcome = (
        F.when(F.col("s.first_at").isNull(), "never")
        .when(~F.col("s.held"), "lost")
        .when(F.col("s.lost_at").isNotNull(), "regained")
        .when(F.col("s.first_at") != F.get("states", 0)["stage"], "late")
        .when(F.col("s.changed_at").isNotNull(), "changed")
        .otherwise("kept")
    )
    out = done.select(*KEYS, "states", "s.first_at", "s.lost_at", "s.lost", "s.regained_at", "s.changed_at", F.col("s.shown").alias("last_shown"), "s.last_status", outcome.alias("outcome"))
    if checks is None:
        return out
    judged = checks.select(*KEYS, F.col("status").alias("rule_status"), F.col("reason_code").alias("rule_reason"))
    return out.join(judged, KEYS, "left")


def by_stage(lost: DataFrame) -> DataFrame:
    """How often each field met each outcome, and at which stage values went first."""
    return lost.groupBy("field_name", "outcome", "lost_at").agg(F.count("*").alias("n"))
