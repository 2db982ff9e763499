"""Exports: injection-safe CSV rows, display rules, audit lines and workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.config import CHECKS, EXPORT_COLUMNS, FIELDS
from proofmark.functions.text import fixed, nonempty, squash


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null as empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def check_statuses(checks: DataFrame) -> DataFrame:
    """Per item one column for each check's status, the worst where a check repeats; null where it has none."""
    names = ("brand_status", "class_type_status", "alcohol_content_status", "net_contents_status", "government_warning_status")
    # Numbers, so that the aggregate is combined in place within tasks.
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "REVIEW", 1).when(F.col("status") == "PASS", 0)
    worst_of = {n: F.max(F.when(F.col("check_name") == check, rank)) for check, n in zip(CHECKS, names, strict=True)}
    found = checks.groupBy("item_id").agg(*(worst.alias(n) for n, worst in worst_of.items()))
    return found.select("item_id", *(F.get(F.array(F.lit("PASS"), F.lit("REVIEW"), F.lit("FAIL")), F.col(n)).alias(n) for n in names))


def batch_rows(items: DataFrame, checks: DataFrame) -> DataFrame:
    """The export's columns as safe text, with item_id for order."""
    j = items.join(check_statuses(checks), "item_id", "left")
    j = j.withColumns({"ai_assisted": F.when(F.col("ai_assisted"), "true").otherwise("false"), "processing_time_ms": fixed(F.col("processing_time_ms")), "error": F.col("error_message")})
    return j.select("item_id", *(safe_cell(F.col(c)).alias(c) for c in EXPORT_COLUMNS))


# Headings of the two reports.
REPORT_COLUMNS = (
    "Filename", "Overall Status", "Brand", "Class / Type", "Alcohol Content", "Net Contents", "Brand Check", "Class / Type Check", "Alcohol Check",
    "Net Contents Check", "Warning Check", "AI Assisted", "Review Reason Codes", "Processing Time (ms)", "Error",
)
METADATA = ("Review ID", "Generated (UTC)", "Filename", "Verification mode", "Overall finding", "Processing time (ms)", "AI-assisted evidence", "Passed", "Needs review", "Failed")
FIELD_LABELS = ("Brand Name", "Class / Type", "Alcohol Content", "Net Contents", "Government Warning")
CHECK_COLUMNS = ("Check", "Status", "Detected Evidence", "Explanation", "Reason Code", "AI Assisted")
SECTIONS = ("Review metadata", "Extracted label information", "Verification checks")


def yes(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def report_rows(items: DataFrame, checks: DataFrame) -> DataFrame:
    """The batch report's result sheet: item_id and ``cells``, one safe text per heading of REPORT_COLUMNS."""
    j = items.join(check_statuses(checks), "item_id", "left")
    cells = [
        F.col("filename"), F.coalesce("overall_status", "processing_state"), F.col("brand_name"), F.col("class_type"), F.col("alcohol_content"), F.col("net_contents"),
        F.col("brand_status"), F.col("class_type_status"), F.col("alcohol_content_status"), F.col("net_contents_status"), F.col("government_warning_status"),
        yes(F.col("ai_assisted")), F.col("review_reason_codes"), fixed(F.col("processing_time_ms")), F.col("error_message"),
    ]
    return j.select("item_id", F.array(*map(safe_cell, cells)).alias("cells"))


def summary_rows(counted: DataFrame, key: str = "batch_id") -> DataFrame:
    """The batch report's summary sheet, from ``summary.batch``: key, place, name and value."""
    named = {"Total": "total", "PASS": "pass_count", "REVIEW": "review_count", "FAIL": "fail_count", "ERROR": "error", "AI-assisted count": "ai_assisted_all"}
    rows = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for i, (n, c) in enumerate(named.items())))
    return counted.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def field_cell(field_name: Column, status: Column, raw: Column, value: Column, explanation: Column) -> Column:
    """What the single report shows for a field; a warning that isn't found shows its text, else why."""
    seen = F.when(nonempty(raw).isNotNull(), F.concat(F.lit("Detected — "), F.substring(raw, 1, 200))).otherwise("Detected")
    warning = F.when(status == "FOUND", seen).otherwise(F.concat(status, F.lit(": "), F.coalesce(nonempty(raw), nonempty(explanation), F.lit(""))))
    shown = F.when(field_name == "government_warning", warning).otherwise(F.coalesce(nonempty(raw), nonempty(value), status))
    return F.when(status.isNull(), "Not extracted").otherwise(shown)


def single_rows(items: DataFrame, fields: DataFrame, checks: DataFrame) -> DataFrame:
    """The single report of every item as rows: item_id, ``at`` (the place in the report), ``section`` and ``cells``.

    ``items`` has review_id, generated (a timestamp), filename, mode, the counts of
    ``summary.items``, ai_assisted and processing_time_ms; ``fields`` is in long form, with an
    explanation where there is one; ``checks`` has field_at, check_name, status, detected_value,
    explanation, reason_code and ai_assisted_evidence.  Each section begins with its heading, that of checks also
    with its columns.  Every item has all five fields; one without a row was not extracted.  Checks that
    repeat stand side by side.
    """
    text = lambda c: safe_cell(F.coalesce(c.cast("string"), F.lit("")))
    generated = F.date_format(F.to_utc_timestamp("generated", F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    values = [F.col("review_id"), generated, F.col("filename"), F.col("mode"), F.col("overall_status"), fixed(F.col("processing_time_ms")), yes(F.col("ai_assisted")), F.col("pass_count"), F.col("review_count"), F.col("fail_count")]
    explanation = F.col("explanation") if "explanation" in fields.columns else F.lit(None).cast("string")
    shown = fields.groupBy("item_id").agg(F.collect_list(F.struct("field_name", field_cell(F.col("field_name"), F.col("status"), F.col("raw_text"), F.col("normalized_value"), explanation).alias("cell"))).alias("shown"))
    row = lambda section, *cells: F.struct(F.lit(section).alias("section"), F.array(*cells).alias("cells"))
    of = lambda name: F.get(F.filter("shown", lambda x: x["field_name"] == name), 0)["cell"]
    meta = [row("metadata", F.lit(SECTIONS[0])), *(row("metadata", F.lit(n), text(v)) for n, v in zip(METADATA, values, strict=True))]
    told = [row("fields", F.lit(SECTIONS[1])), *(row("fields", F.lit(label), text(F.coalesce(of(name), F.lit("Not extracted")))) for name, label in zip(FIELDS, FIELD_LABELS, strict=True))]
    head = [row("checks", F.lit(SECTIONS[2])), row("checks", *map(F.lit, CHECK_COLUMNS))]
    fixed_rows = [*meta, *told, *head]
    top = items.join(shown, "item_id", "left").select("item_id", F.posexplode(F.array(*fixed_rows)).alias("at", "x")).select("item_id", "at", "x.section", "x.cells")
    cells = F.array(*(text(F.col(c)) for c in ("check_name", "status", "detected_value", "explanation", "reason_code")), yes(F.coalesce("ai_assisted_evidence", F.lit(False))))
    each = checks.join(items.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("field_at", cells.alias("cells")))).alias("judged"))
    judged = each.select("item_id", F.posexplode("judged").alias("place", "x")).select("item_id", (F.col("place") + len(fixed_rows)).alias("at"), F.lit("checks").alias("section"), "x.cells")
    return top.unionByName(judged)


def trial_json(trials: DataFrame) -> DataFrame:
    """Each trial as one line of JSON, nulls kept."""
    return trials.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def csv_line(columns: list[Column]) -> Column:
    """One line of CSV, quoted only where needed."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in columns]
    return F.concat_ws(",", *quoted)


def write_csv(rows: DataFrame, path: str) -> None:
    """Writes the export in order of items; ranges are sorted in parallel, so file parts follow one another."""
    rows.orderBy("item_id").drop("item_id").write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def display(field_name: Column, raw: Column, value: Column, status: Column) -> Column:
    """What a report shows for a field."""
    warning = F.when(nonempty(raw).isNotNull(), F.concat(F.lit("Detected — "), F.substring(raw, 1, 200)))
    return F.when(field_name == "government_warning", F.coalesce(warning, status)).otherwise(F.coalesce(nonempty(raw), nonempty(value), status))


def audit(event: Column, message: Column, **more: Column) -> Column:
    """One line of JSON; nulls are left out, the message is one line of at most 240 characters."""
    return F.to_json(F.struct(event.alias("event"), F.substring(squash(message), 1, 240).alias("message"), *(c.alias(k) for k, c in more.items())))


def flattened(trials: DataFrame, names: list[str]) -> DataFrame:
    """Trials with a column per recovered field and a one-line preview."""
    kept = [c for c in trials.columns if c not in ("field_recovery", "preview")]
    return trials.select(*kept, *(F.col("field_recovery")[n].alias(f"field_{n}") for n in names), F.replace("preview", F.lit("\n"), F.lit(" | ")).alias("preview"))


def workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """Writes small, already collected sheets; needs openpyxl, which is not a dependency."""
    import openpyxl

    book = openpyxl.Workbook()
    book.remove(book.active)
    for name, rows in sheets.items():
        sheet = book.create_sheet(name)
        for row in rows:
            sheet.append(row)
    book.save(path)
