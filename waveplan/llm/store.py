"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveplan.session import cleaned, shared_folder

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch, as texts are long; a value the user has set stays.
_BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, _BATCH_ROWS)


class Run:
    """A folder of its own for the intermediate tables of one call.

    A table that was written is read again instead of computed: a lost executor costs no
    earlier step, and the shuffle files of the step that wrote it go at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        with cleaned(self.spark):
            df.write.parquet(f"{self.path}/{name}", partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part_of(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))
