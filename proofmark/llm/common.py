"""Helpers shared by the corpus operators: reading, Arrow mapping, shared tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of text handed to Python at a time; texts may be long, so batches stay small.
BATCH_ROWS = 512
#: Rows that ``map_pieces`` puts together before it hands them back.
OUT_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` with null as empty, and further columns; all others are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]], ddl: str) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of row tuples; the schema is DDL.

    Batches are kept small so that a worker holds few texts at a time.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batches):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def map_arrays(df: DataFrame, arrays: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], ddl: str) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns (arrays or lists); the schema is DDL."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in arrays(batches):
            if out:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def map_pieces(df: DataFrame, pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], ddl: str) -> DataFrame:
    """``map_arrays`` for many small lists of columns (numpy arrays or lists): they are put together until they hold ``OUT_ROWS`` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def joined(held: list[list]) -> list:
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else list(chain.from_iterable(c)) for c in zip(*held, strict=True)]

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held, n = [], 0
        for piece in pieces(batches):
            held.append(piece)
            n += len(piece[0])
            if n >= OUT_ROWS:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    return map_arrays(df, arrays, ddl)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within hands so many rows at a time to Python; afterwards the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def meets(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether (start, end) overlaps any of the spans, in time logarithmic in their number."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def met(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1
        return i >= 0 and ends[i] > a

    return met


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only for a local master without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='proofmark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, so a lost executor costs one task, not the whole plan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by ``store`` that no later plan reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan needs: it does so once the driver has collected the plans that made them, which may take long after a big stage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def keep_rows(df: DataFrame, text: str, keeps: Callable[[Iterator[list[str]]], Iterator[list[bool]]]) -> DataFrame:
    """The rows whose text is kept, with all columns as they are; ``keeps`` maps batches of texts (null: empty) to batches of verdicts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def read() -> Iterator[list[str]]:
            for b in batches:
                held.append(b)
                yield [t or "" for t in b.column(at).to_pylist()]

        for verdict in keeps(read()):
            yield held.pop().filter(pa.array(verdict, pa.bool_()))

    return df.mapInArrow(run, df.schema)
