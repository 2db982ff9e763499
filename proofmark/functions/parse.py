"""Alcohol statements, net contents, and other values, parsed by column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmark.config import ABV_PATTERNS, AUTHORIZED_ABV, NET_BENIGN, NET_PATTERN, NUMBER, PROOF_PATTERN, WARNING_HEADER
from proofmark.functions.text import general, let, nonempty, strip

I = "(?i)"  # noqa: E741


def _extract(t: Column, pattern: str, group: int) -> Column:
    return let(F.regexp_extract(t, I + pattern, group), nonempty)


def alcohol(t: Column) -> Column:
    """Struct of abv, proof, source (abv, proof, both), abv_span, proof_span and raw; null without any statement.

    The first pattern that matches anywhere gives the number; proof alone halves to abv.
    """

    def spans(low: Column) -> Column:
        # Every pattern names one of these words, and states a volume or a percentage.
        abv = F.when(low.contains("abv") | low.contains("alc") & (low.contains("vol") | low.contains("%")), F.coalesce(*(_extract(t, p, 1) for p in ABV_PATTERNS)))
        return F.struct(abv.alias("abv"), F.when(low.contains("proof"), _extract(t, PROOF_PATTERN, 1)).alias("proof"))

    def numbered(s: Column) -> Column:
        # A span's only number is its pattern's.
        return F.struct(
            F.regexp_extract(s["abv"], NUMBER, 0).cast("double").alias("number"),
            strip(s["abv"]).alias("span"),
            F.regexp_extract(s["proof"], r"\d{1,3}(?:\.\d+)?", 0).cast("double").alias("proof"),
            strip(s["proof"]).alias("proof_span"),
            strip(t).alias("all"),
        )

    def parsed(x: Column) -> Column:
        only, both = x["number"].isNull() & x["proof"].isNotNull(), x["number"].isNotNull() & x["proof"].isNotNull()
        made = F.struct(
            F.when(only, x["proof"] / 2).otherwise(x["number"]).alias("abv"),
            x["proof"].alias("proof"),
            F.when(both, "both").when(only, "proof").otherwise("abv").alias("source"),
            x["span"].alias("abv_span"),
            x["proof_span"].alias("proof_span"),
            F.when(only, x["proof_span"]).when(both, x["all"]).otherwise(x["span"]).alias("raw"),
        )
        return F.when(x["number"].isNotNull() | x["proof"].isNotNull(), made)

    def found(s: Column) -> Column:
        return F.when(s["abv"].isNotNull() | s["proof"].isNotNull(), let(numbered(s), parsed))

    return let(let(F.lower(t), spans), found)


def alcohol_display(a: Column) -> Column:
    def shown(x: Column) -> Column:
        percent = F.concat(general(x["abv"]), F.lit("% Alc./Vol."))
        proof = F.concat(F.lit("proof="), general(x["proof"]))
        return F.when(x["source"] == "proof", proof).when(x["proof"].isNotNull(), F.concat(percent, F.lit(" ("), proof, F.lit(")"))).when(x["abv"].isNotNull(), percent)

    return let(a, shown)


def net(t: Column) -> Column:
    """Struct of value, unit (mL, L), span and display; null without a quantity."""

    def read(span: Column) -> Column:
        # A span is a number, spaces, and the unit's letters.
        said = F.struct(F.regexp_extract(span, r"\d+(?:\.\d+)?", 0).cast("double").alias("value"), F.regexp_extract(span, r"(?is)[a-z].*", 0).alias("unit"), strip(span).alias("span"))
        return F.when(span.isNotNull(), let(said, parsed))

    def parsed(x: Column) -> Column:
        unit = F.when(F.regexp_replace(F.lower(x["unit"]), r"[\s.]", "") == "ml", "mL").otherwise("L")
        made = F.struct(x["value"].alias("value"), unit.alias("unit"), x["span"].alias("span"), F.concat(general(x["value"]), F.lit(" "), unit).alias("display"))
        return F.when(x["value"].isNotNull(), made)

    return let(_extract(t, NET_PATTERN, 1), read)


def net_reliable(line: Column, span: Column) -> Column:
    """Whether no letters are left once the span (its first occurrence, in any case) and harmless context are taken away."""
    at = F.position(F.lower(span), F.lower(line))
    rest = F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.lit(" "), F.substring(line, at + F.length(span), F.length(line)))).otherwise(line)
    left = F.regexp_replace(rest, I + NET_BENIGN, " ")
    return F.coalesce((line != "") & (span != "") & ~left.rlike(r"\p{L}"), F.lit(False))


def application_abv(t: Column) -> Column:
    """The statement's abv, else the first one or two digits (with decimals) of anything."""
    return F.coalesce(alcohol(t)["abv"], nonempty(F.regexp_extract(t, r"(\d{1,2}(?:\.\d+)?)\s*%?", 1)).cast("double"))


def to_ml(value: Column, unit: Column) -> Column:
    return F.when(unit == "L", value * 1000.0).otherwise(value)


def application_net_ml(t: Column) -> Column:
    return let(net(t), lambda n: to_ml(n["value"], n["unit"]))


def authorized_abv(t: Column) -> Column:
    """Whether the text states a percentage by volume in an accepted form."""
    return F.coalesce((t != "") & (t.rlike(I + AUTHORIZED_ABV) | F.coalesce(alcohol(t)["source"].isin("abv", "both"), F.lit(False))), F.lit(False))


def within(a: Column, b: Column, epsilon: float) -> Column:
    return F.abs(a - b) <= epsilon


def heading_is_upper(t: Column) -> Column:
    """Of the warning heading: true in capitals, false in mixed case, null in small letters or without one."""
    head = F.regexp_extract(t, f"(?i)({WARNING_HEADER})", 1)
    return F.when(head == "", None).when(head == F.upper(head), True).when(head != F.lower(head), False)


def evidence_json(c: Column, requested: tuple[str, ...]) -> Column:
    """Rows of a provider's JSON answer: requested fields only, unknown confidence as LOW, blanks as null."""
    parsed = F.from_json(c, "fields array<struct<field:string,candidate_value:string,raw_observed_text:string,confidence:string,evidence_description:string,unable_to_determine:boolean>>")
    rows = F.filter(parsed["fields"], lambda x: x["field"].isin(*requested))

    def tidy(x: Column) -> Column:
        said = F.upper(x["confidence"])
        blank = lambda v: nonempty(strip(v))
        return F.struct(
            x["field"].alias("field"),
            blank(x["candidate_value"]).alias("candidate_value"),
            blank(x["raw_observed_text"]).alias("raw_observed_text"),
            F.when(said.isin("HIGH", "MEDIUM", "LOW"), said).otherwise("LOW").alias("confidence"),
            F.coalesce(x["unable_to_determine"], F.lit(False)).alias("unable_to_determine"),
        )

    return F.transform(rows, tidy)


def fit_edge(width: Column, height: Column, edge: int) -> Column:
    """Size with the longer side at most ``edge``; never larger than before, never under 1."""
    longest = F.greatest(width, height)
    side = lambda x: F.greatest(F.lit(1), F.floor(x * (edge / longest)).cast("int"))
    return F.when(longest <= edge, F.struct(width.alias("width"), height.alias("height"))).otherwise(F.struct(side(width).alias("width"), side(height).alias("height")))


def box_edges(box: Column) -> Column:
    """Left, top, width and height of a box of x_min, y_min, x_max, y_max; a missing top is far below."""
    height = F.greatest(F.lit(0.0), F.coalesce(box["y_max"] - box["y_min"], F.lit(0.0)))
    width = F.coalesce(F.greatest(F.lit(0.0), box["x_max"] - box["x_min"]), F.when(height > 0, height).otherwise(10.0))
    return F.struct(F.coalesce(box["x_min"], F.lit(0.0)).alias("left"), F.coalesce(box["y_min"], F.lit(1e9)).alias("top"), width.alias("width"), height.alias("height"))


def overlay(box: Column, width: Column, height: Column, shown_w: float, shown_h: float) -> Column:
    """A box scaled into an aspect-fit frame."""
    scale = F.least(shown_w / width, shown_h / height)
    left, top = (shown_w - width * scale) / 2, (shown_h - height * scale) / 2
    e = box_edges(box)
    return F.struct((left + e["left"] * scale).alias("left"), (top + e["top"] * scale).alias("top"), (e["width"] * scale).alias("width"), (e["height"] * scale).alias("height"))


def polygon_box(polygon: Column) -> Column:
    """The upright box round a polygon of [x, y] points."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x_min"), F.array_min(y).alias("y_min"), F.array_max(x).alias("x_max"), F.array_max(y).alias("y_max"))


def first_of(*c: Column) -> Column:
    """The first that is neither null nor empty."""
    return reduce(lambda a, b: F.coalesce(a, b), map(nonempty, c))
