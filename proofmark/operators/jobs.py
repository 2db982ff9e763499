"""The store of batch jobs: items of a batch are put as a whole and got by their batch.

Rows lie in Parquet, parted by batch.  A put replaces what the store holds of its
batches and of no others, so putting a batch again, after a failure or for a new state,
leaves one copy of it.  Parts are named by batches; a get reads the files of its own.
Put writes with one writer at a time for a batch; other batches aren't touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = (
    "batch_id string, item_id string, filename string, brand_name string, class_type string, alcohol_content string, net_contents string, "
    "processing_state string, overall_status string, ai_assisted boolean, processing_time_ms double, error_code string, error_message string, review_reason_codes array<string>"
)


class JobStore:
    """Items of batch jobs under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str = ITEMS, key: str = "batch_id"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def put(self, items: DataFrame, files: int = 0) -> None:
        """Stores items; of each batch among them the store then holds these items alone.

        Rows without a batch are refused.  Each task writes its rows of a batch to a file
        of its own, unless ``files`` says how many files a batch has at most, at the cost of a shuffle.
        """
        rows = items.withColumn(self.key, F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"an item has no {self.key}"))).otherwise(F.col(self.key).cast("string")))
        if files:
            rows = rows.repartition(F.col(self.key), F.pmod(F.xxhash64(*[c for c in rows.columns if c != self.key]), F.lit(files)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)

    def all(self) -> DataFrame:
        """All items of all batches; none if nothing has been put."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def get(self, *batches: str) -> DataFrame:
        """The items of the batches; only their files are read.  Batches that the store doesn't hold have none."""
        return self.all().where(F.col(self.key).isin(*map(str, batches)))

    def batches(self) -> DataFrame:
        """The batches held, with the number of their items."""
        return self.all().groupBy(self.key).agg(F.count("*").alias("n"))

    def clear(self, *batches: str) -> None:
        """Forgets the batches, or all of them if none is named."""
        if not self._exists():
            return
        if not batches:
            self._files().delete(self._path(self.path), True)
            return
        # Names of parts are escaped, so they are taken from the files themselves: one name for each batch.
        folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
        for r in self.get(*batches).groupBy(self.key).agg(F.max(folder).alias("folder")).collect():
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI.create(r.folder)), True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self) -> bool:
        return self._files().exists(self._path(self.path))
