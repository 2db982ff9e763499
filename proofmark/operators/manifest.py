"""Checking a batch: manifest rows against uploaded images.

Everything is a join or an aggregate over the two tables; issues are rows, in
the order (phase, ordinal) in which they arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmark.config import APPLICATION_LENGTHS, DEFAULT, MANIFEST_COLUMNS, Settings
from proofmark.functions.text import is_image_name, safe_filename, strip


def sample(spark: SparkSession) -> DataFrame:
    """Three rows of a well-formed manifest."""
    rows = [("old-tom-001.jpg", "OLD TOM DISTILLERY", "Kentucky Straight Bourbon Whiskey", "45%", "750 mL"), ("stones-throw-002.jpg", "Stone's Throw", "Straight Bourbon Whiskey", "40%", "750 mL"), ("demo-review-003.jpg", "North Peak Distilling", "Bourbon Whiskey", "45%", "750 mL")]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in MANIFEST_COLUMNS))


def application_ok(row: dict[str, Column]) -> Column:
    """Whether all four values are there and none is too long (lengths count before stripping)."""
    ok = F.lit(True)
    for name, most in APPLICATION_LENGTHS.items():
        ok = ok & (F.length(row[name]) <= most) & (strip(row[name]) != "")
    return F.coalesce(ok, F.lit(False))


def image_states(images: DataFrame) -> DataFrame:
    """Uploaded names (filename, ordinal) with their safe name and problem."""
    safe = safe_filename(F.col("filename"))
    return images.select("filename", "ordinal", safe.alias("safe")).withColumn("code", F.when(F.col("safe").isNull(), "unsafe_image_filename").when(~is_image_name(F.col("safe")), "unsupported_image"))


def inventory(images: DataFrame) -> DataFrame:
    """Usable names with how often they were uploaded."""
    return image_states(images).where("code is null").groupBy("safe").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"))


def latest_content(uploads: DataFrame) -> DataFrame:
    """Of uploads (filename, ordinal, content) the last content of each safe name."""
    return uploads.withColumn("safe", safe_filename(F.col("filename"))).where("safe is not null").groupBy("safe").agg(F.max_by("content", "ordinal").alias("content"))


def rows(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows (row_number and the five columns) with safe name and ``code`` of the first problem (null: matched)."""
    safe = manifest.withColumn("safe", safe_filename(F.col("filename")))
    # Only valid names are numbered, so invalid ones, which have none, do not meet in one task.
    first = safe.where("safe is not null").groupBy("safe").agg(F.min("row_number").alias("first"))
    seen = safe.join(first, "safe", "left").withColumn("again", F.coalesce(F.col("row_number") > F.col("first"), F.lit(False))).drop("first")
    ok = application_ok({c: F.col(c) for c in APPLICATION_LENGTHS})
    found = seen.join(inventory(images).select("safe", F.col("n").alias("uploads")), "safe", "left")
    code = F.when(F.col("safe").isNull(), "invalid_filename").when(F.col("again"), "duplicate_filename").when(~ok, "invalid_application_values").when(F.col("uploads").isNull() | (F.col("uploads") > 1), "missing_image")
    return found.withColumn("code", code).drop("again")


def matched(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Rows whose image is there exactly once."""
    return rows(manifest, images).where("code is null")


def missing(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Rows whose image was not uploaded."""
    return manifest.withColumn("safe", safe_filename(F.col("filename"))).where("safe is not null").join(inventory(images), "safe", "left_anti")


def ambiguous(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Rows whose image was uploaded more than once."""
    return manifest.withColumn("safe", safe_filename(F.col("filename"))).join(inventory(images).where("n > 1"), "safe", "left_semi")


def unreferenced(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Images uploaded once that no matched row names."""
    return inventory(images).where("n = 1").join(matched(manifest, images), "safe", "left_anti").select("safe")


def issues(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """All issues: phase, ordinal, code, filename, row_number."""
    none = F.lit(None).cast("long")
    bad = image_states(images).where("code is not null").select(F.lit(1).alias("phase"), F.col("ordinal").cast("long"), "code", F.coalesce("safe", "filename").alias("filename"), none.alias("row_number"))
    twice = inventory(images).where("n > 1").select(F.lit(2).alias("phase"), F.col("ordinal").cast("long"), F.lit("duplicate_image").alias("code"), F.col("safe").alias("filename"), none.alias("row_number"))
    each = rows(manifest, images).where("code is not null").select(F.lit(3).alias("phase"), F.col("row_number").cast("long").alias("ordinal"), "code", F.coalesce("safe", F.when(F.col("filename") != "", F.col("filename"))).alias("filename"), F.col("row_number").cast("long"))
    extra = unreferenced(manifest, images).select(F.lit(4).alias("phase"), F.lit(0).cast("long").alias("ordinal"), F.lit("unreferenced_image").alias("code"), F.col("safe").alias("filename"), none.alias("row_number"))
    return bad.unionByName(twice).unionByName(each).unionByName(extra)


def validate(manifest: DataFrame, images: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row: valid and the counts.  Only unreferenced images don't stand in the way; an oversized or empty manifest does at once."""
    n = rows(manifest, images).agg(F.count("*").alias("row_count"), F.count_if(F.col("code").isNull()).alias("matched_count"), F.count_if(~F.col("code").isin("invalid_filename", "duplicate_filename")).alias("unmatched"))
    m = images.agg(F.count("*").alias("image_count"))
    u = unreferenced(manifest, images).agg(F.count("*").alias("unreferenced"))
    i = issues(manifest, images).agg(F.count_if(F.col("code") != "unreferenced_image").alias("blocking"))
    one = n.crossJoin(m).crossJoin(u).crossJoin(i)  # one row each
    fits = (F.col("row_count") > 0) & (F.col("row_count") <= settings.batch_max_items)
    valid = fits & (F.col("matched_count") == F.col("row_count")) & (F.col("blocking") == 0)
    count = lambda c: F.when(fits, c).otherwise(0).cast("long")
    return one.select(valid.alias("valid"), "row_count", count(F.col("image_count")).alias("image_count"), count(F.col("matched_count")).alias("matched_count"), count(F.when(valid, 0).otherwise(F.col("unmatched"))).alias("missing_count"), count(F.col("unreferenced")).alias("unreferenced_count"))
