"""Measuring recognition: trials over fixtures, engines, profiles and edges, and their leaderboards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmark.functions import parse
from proofmark.functions.similarity import partial_ratio
from proofmark.functions.text import eval_normalize, fixed
from proofmark.operators.stages import Stages


def matrix(fixtures: DataFrame, providers: DataFrame, profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Every combination to try; the three small axes are sent to the fixtures' tasks."""
    return fixtures.crossJoin(F.broadcast(providers)).crossJoin(F.broadcast(profiles)).crossJoin(F.broadcast(edges))


def recovered(field_name: Column, exact: Column, semantic: Column, text: Column, least: float = 80.0) -> Column:
    """Whether the recognised text holds a field: its number, or a window like its wording."""
    number = F.when(field_name == "alcohol_content", parse.application_abv(text)).when(field_name == "net_contents", parse.application_net_ml(text))
    wanted = semantic.try_cast("double") if hasattr(semantic, "try_cast") else semantic.cast("double")
    return F.coalesce(F.abs(number - wanted) < 1e-6, F.lit(False)) | (partial_ratio(eval_normalize(exact), eval_normalize(text)) >= least)


def _rates() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg("fields_recovered").alias("mean_fields"),
        F.coalesce(F.avg("cer"), F.lit(1.0)).alias("mean_cer"),
        F.percentile("total_ms", 0.5).alias("median_ms"),
        F.percentile("total_ms", 0.95).alias("p95_ms"),
        F.avg(F.col("has_boxes").cast("int")).alias("box_rate"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
    ]


def leaderboard(trials: DataFrame, *keys: str) -> DataFrame:
    return trials.groupBy(*keys).agg(*_rates())


def marginals(trials: DataFrame) -> DataFrame:
    """By profile and by edge, in one pass."""
    return trials.groupingSets([[F.col("profile")], [F.col("edge")]], F.col("profile"), F.col("edge")).agg(F.count("*").alias("n"), F.avg("fields_recovered").alias("mean_fields"), F.avg("cer").alias("mean_cer"))


def recovery_rates(trials: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Per key and field the share of all trials, failed ones too, that recovered it (``field_recovery``: a map by field)."""
    return trials.groupBy(*keys).agg(*(F.avg(F.coalesce(F.col("field_recovery")[n], F.lit(False)).cast("int")).alias(n) for n in names))


def order(board: DataFrame) -> DataFrame:
    """Best first: most fields, then the least median time, then the least error."""
    return board.orderBy(F.desc("mean_fields"), "median_ms", "mean_cer", "provider", "profile", "edge")


def best_within(board: DataFrame, budget_ms: float, least_fields: float) -> DataFrame:
    return order(board.where((F.col("median_ms") <= budget_ms) & (F.col("mean_fields") >= least_fields))).limit(1)


def failures(trials: DataFrame) -> DataFrame:
    return trials.where(~F.col("success")).groupBy(F.coalesce("failure_kind", F.lit("unknown")).alias("failure_kind")).agg(F.count("*").alias("n"))


def successful(trials: DataFrame, *keys: str) -> DataFrame:
    """Counts over all trials, times over those that succeeded."""
    ok = F.when(F.col("success"), F.col("total_ms"))
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg(F.when(F.col("success"), F.col("fields_recovered"))).alias("mean_fields"), F.percentile(ok, 0.5).alias("median_ms"), F.percentile(ok, 0.95).alias("p95_ms"), F.max(ok).alias("max_ms"))


# The report's headings, and the format of its lines.
HEADINGS = ("# OCR Evaluation Summary", "## Environment", "## Providers", "## Configuration leaderboard (by mean field recovery, then latency)", "## Field recovery by provider (all configs pooled)", "## FAST vs ENHANCED (pooled)", "## Working resolution (pooled)", "## Failure cases", "## Evidence-based recommendation notes")
BOARD_HEAD = ("| Provider | Preprocess | Max edge | Mean fields/5 | Mean CER | Median total ms | p95 total ms | BBox rate | Success rate |", "|---|---|---:|---:|---:|---:|---:|---:|---:|")
NO_TRIALS, NO_FAILURES = "No evaluation records were produced.", "No hard failures recorded."
OVER_BUDGET = "No configuration met both median <= 2000 ms and mean fields >= 3.0 on this corpus/environment."
RECOVERED = ("brand_name", "class_type", "alcohol_content_abv", "net_contents", "government_health_warning")


def _whole(c: Column) -> Column:
    """A number without decimals, halves to even."""
    return F.bround(c, 0).cast("long").cast("string")


def _line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _fixed_lines(generated: str, environment: dict[str, str], requested: list[str], available: list[str], unavailable: dict[str, str], profiles: list[str], edges: list[int]) -> list[list[str]]:
    """The lines of the first three sections, which no trial decides."""
    named = lambda names: ", ".join(names) or "(none)"
    away = ["- Unavailable:", *(f"  - `{n}`: {why}" for n, why in unavailable.items())] if unavailable else []
    return [
        [HEADINGS[0], "", f"Generated: `{generated}`", ""],
        [HEADINGS[1], *(f"- **{k}:** {v}" for k, v in environment.items()), ""],
        [HEADINGS[2], f"- Requested: {named(requested)}", f"- Available: {named(available)}", *away, "", f"Profiles: {', '.join(profiles)}; max edges: {', '.join(map(str, edges))}", ""],
    ]


def report(trials: DataFrame, generated: str, environment: dict[str, str], requested: list[str], available: list[str], unavailable: dict[str, str], profiles: list[str], edges: list[int], names: tuple[str, ...] = RECOVERED) -> DataFrame:
    """The evaluation report as rows: ``section``, ``place`` and ``line``, in whose order it reads.

    All figures come from one pass over the trials, by grouping sets over configuration, provider, profile
    and edge; a second one counts failures.  Profiles and edges that were asked for
    and have no trials show zeros.  ``trials`` has the columns of ``leaderboard`` and field_recovery
    (a map by field).  Configurations that tie stand in the order of their names.
    """
    spark = trials.sparkSession
    lines = lambda section, texts: [(section, i, t) for i, t in enumerate(texts)]
    told = [x for s, texts in enumerate(_fixed_lines(generated, environment, requested, available, unavailable, profiles, edges)) for x in lines(s, texts)]
    rows = lambda made: spark.createDataFrame(made, "section int, place long, line string")
    if trials.isEmpty():
        return rows(told + [(3, 0, NO_TRIALS)])
    head = {3: [HEADINGS[3], "", *BOARD_HEAD], 4: [HEADINGS[4], "", "| Provider | " + " | ".join(names) + " |", "|---|" + "|".join(["---:"] * len(names)) + "|"], **{s: [HEADINGS[s], ""] for s in (5, 6, 7, 8)}}
    told += [x for s, texts in head.items() for x in lines(s, texts)]
    # Data lines stand behind their heading; an empty line ends each section.
    last = 1 << 40
    told += [(s, last, "") for s in head]

    p, f, e = F.col("provider"), F.col("profile"), F.col("edge")
    rates = [F.avg(F.coalesce(F.col("field_recovery")[n], F.lit(False)).cast("int")).alias(f"field_{n}") for n in names]
    made = trials.groupingSets([[p, f, e], [p], [f], [e]], p, f, e).agg(F.grouping_id("provider", "profile", "edge").alias("level"), *_rates(), *rates)
    figures = Stages(spark).store("figures", made, keep=True)  # a row for each configuration, provider, profile and edge

    def placed(df: DataFrame, section: int, line: Column, *order: Column, after: int) -> DataFrame:
        """Lines in an order; there are as many as configurations, providers, or kinds of failure."""
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + after
        return df.select(F.lit(section).alias("section"), place.cast("long").alias("place"), line.alias("line"))

    best = [F.desc("mean_fields"), F.col("median_ms"), F.col("mean_cer"), p, f, e]
    configured = figures.where("level = 0")
    board = placed(configured, 3, _line("| ", p, " | ", f, " | ", e, " | ", fixed(F.col("mean_fields"), 2), " | ", fixed(F.col("mean_cer"), 3), " | ", _whole(F.col("median_ms")), " | ", _whole(F.col("p95_ms")), " | ", fixed(F.col("box_rate"), 2), " | ", fixed(F.col("success_rate"), 2), " |"), *best, after=3)
    pooled = placed(figures.where("level = 3"), 4, F.concat(F.lit("| "), p, F.lit(" | "), F.concat_ws(" | ", *(fixed(F.col(f"field_{n}"), 2) for n in names)), F.lit(" |")), p, after=3)

    def asked(section: int, values: list, column: str, level: int, line: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
        """A line for each value asked for, with zeros where it has no trials."""
        wanted = spark.createDataFrame([(i + 2, v) for i, v in enumerate(values)], f"place long, {column} {dict(figures.dtypes)[column]}")
        j = wanted.join(figures.where(F.col("level") == level).select(column, "mean_fields", "median_ms", "mean_cer"), column, "left")
        zero = lambda c, z=0.0: F.coalesce(c, F.lit(z))
        return j.select(F.lit(section).alias("section"), "place", line(F.col(column), zero("mean_fields"), zero("median_ms"), zero("mean_cer", 1.0)).alias("line"))

    by_profile = asked(5, profiles, "profile", 5, lambda v, n, ms, cer: _line("- **", v, ":** mean fields=", fixed(n, 2), ", median total=", _whole(ms), " ms, mean CER=", fixed(cer, 3)))
    by_edge = asked(6, edges, "edge", 6, lambda v, n, ms, cer: _line("- **", v, "px:** mean fields=", fixed(n, 2), ", median total=", _whole(ms), " ms"))
    failed = placed(failures(trials), 7, _line("- `", F.col("failure_kind"), "`: ", F.col("n")), F.desc("n"), F.col("failure_kind"), after=1)
    none_failed = rows([(7, 2, NO_FAILURES)]).join(failed.limit(1).select(F.lit(7).alias("section")), "section", "left_anti")
    config = lambda: _line("**", p, " / ", f, " / ", e, "px** (mean fields ", fixed(F.col("mean_fields"), 2))
    first = configured.orderBy(*best).limit(1).select(F.lit(8).alias("section"), F.lit(2).cast("long").alias("place"), F.concat(F.lit("Top configuration by field recovery then latency: "), config(), _line("/5, median ", _whole(F.col("median_ms")), " ms).")).alias("line"))
    within = configured.where("median_ms <= 2000 and mean_fields >= 3.0").orderBy(*best).limit(1).select(F.lit(8).alias("section"), F.lit(3).cast("long").alias("place"), F.concat(F.lit("Best config with median total <= 2000 ms and mean fields >= 3.0: "), config(), _line(", median ", _whole(F.col("median_ms")), " ms).")).alias("line"))
    over = rows([(8, 3, OVER_BUDGET)]).join(within.select("section"), "section", "left_anti")
    every = [rows(told), board, pooled, by_profile, by_edge, failed, none_failed, first, within, over]
    return reduce(DataFrame.unionByName, every)


def write_report(rows: DataFrame, path: str) -> None:
    """Writes the report's lines in order as one text file."""
    rows.orderBy("section", "place").select("line").coalesce(1).write.mode("overwrite").text(path)
