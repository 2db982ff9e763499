"""Readers: CSV manifests, uploads, ground truth, applications, recognised text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from proofmark.config import FIELDS, MANIFEST_COLUMNS
from proofmark.functions.text import strip
from proofmark.operators.extract import WORDS
from proofmark.operators.ranks import numbered

OCR_SCHEMA = f"item_id string, profile string, provider_name string, full_text string, words {WORDS}, image_width_px int, image_height_px int, processing_time_ms double, warnings array<string>, errors array<string>"
TRUTH_SCHEMA = "fixture_id string, image_file string, category string, " + ", ".join(f"{f} struct<exact_text:string,semantic_value:string>" for f in FIELDS) + ", notes string, is_synthetic boolean"
MANIFEST_ROWS = "path string, row_number long, " + ", ".join(f"{c} string" for c in MANIFEST_COLUMNS) + ", problem string"
APPLICATION_SCHEMA = "brand_name string, class_type string, alcohol_content_abv string, net_contents string, notes string"


def _cells(content: bytes) -> Iterator[list]:
    """The rows of a manifest, each its number from 2 and its cells, or one row with what is wrong with the file."""
    wrong = lambda code: [None, *[None] * len(MANIFEST_COLUMNS), code]
    if not content.strip():
        yield wrong("empty_manifest")
        return
    try:
        rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
        headers = [h.strip().lower() for h in next(rows, [])]
        if not set(MANIFEST_COLUMNS) <= set(headers):
            yield wrong("missing_columns")
            return
        # Of headers that repeat, the last one counts; of a row's cells, those under headers.
        places = [len(headers) - 1 - headers[::-1].index(c) for c in MANIFEST_COLUMNS]
        number = 1
        for row in rows:
            if row:
                number += 1
                yield [number, *(row[p].strip() if p < len(row) else "" for p in places), None]
        if number == 1:
            yield wrong("empty_manifest")
    except UnicodeDecodeError:
        yield wrong("manifest_encoding")
    except csv.Error:
        yield wrong("manifest_unreadable")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The rows of any number of manifests: path, row_number, the five columns, and problem.

    Files are dealt to tasks and read there, each as one stream, so rows are numbered
    within their file and no task sees more than its own files.  Numbers begin at 2, blank
    lines aside.  Headers and cells are stripped, a byte-order mark is dropped, missing cells are empty.  A file
    that can't be read, or has no rows, gives one row with its problem and no number; rows
    before the place where reading failed stay.  Files without a single byte are passed over by Spark and have no row.
    """
    schema = to_arrow_schema(StructType.fromDDL(MANIFEST_ROWS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = ([name.as_py(), *row] for row in _cells(content.as_py()))
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, MANIFEST_ROWS)


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """One manifest with row numbers from 2, or the code of what is wrong with the file."""
    read = manifests(spark, path)
    told = read.agg(F.max("problem").alias("problem"), F.count("row_number").alias("n")).first()
    problem = told.problem or (None if told.n else "empty_manifest")
    return (None, problem) if problem else (read.select(*MANIFEST_COLUMNS, "row_number"), None)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: filename, ordinal (the place of their path among all, from 1), content and size.

    Paths are numbered in ranges, contents stay out of it.
    """
    files = spark.read.format("binaryFile").load(path)
    placed = numbered(files.select("path"), "ordinal", "path")
    return files.join(placed, "path").select(F.element_at(F.split("path", "/"), -1).alias("filename"), "ordinal", "content", F.col("length").alias("size"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path).orderBy("fixture_id")


def recognised(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results as JSON lines."""
    return spark.read.schema(OCR_SCHEMA).json(path)


def applications(c: Column) -> Column:
    """An application from its JSON; null where it is not valid JSON."""
    parsed = F.from_json(c, f"{APPLICATION_SCHEMA}, _corrupt_record string", {"mode": "PERMISSIVE"})
    return F.when(parsed["_corrupt_record"].isNull(), parsed)


def has_text(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def has_boxes(words: Column) -> Column:
    return F.coalesce(F.exists(words, lambda w: w["bbox"].isNotNull()), F.lit(False))
