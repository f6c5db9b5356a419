"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
SHUFFLE_BYTES = 256 * 1024 * 1024


def build_session(master: str | None = None, cores: int = 8, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the submitter's settings apply."""
    builder = (
        SparkSession.builder.appName("waveplan")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "12g")
        )
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Start shuffles with enough partitions for an input of ``input_bytes``.

    Adaptive execution merges partitions that turn out small but never splits one below
    a window or aggregate, so the number has to be large enough from the start.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(usual, -(-input_bytes // SHUFFLE_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", wanted)
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, in local runs only, a folder beside the warehouse tables is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


_WRITTEN: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, name: str, paths: list[str] | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; its path is added to ``paths``.

    Later steps restart from the files when an executor is lost, and read the columns they
    need instead of the input, and the shuffle files of the step that wrote it go at once. The files go with
    :func:`release`, at the latest at exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waveplan/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    if paths is not None:
        paths.append(path)
    with cleaned(spark):
        df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what :func:`materialize` has written, all of it or the named tables."""
    for path in list(_WRITTEN if paths is None else paths):
        _WRITTEN.remove(path)
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception as gone:  # the session may have ended before
            warnings.warn(f"{path} could not be deleted: {gone}", stacklevel=2)
    if paths:
        paths.clear()


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A parameter table of known small size, planned as a local relation."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    types = {
        T.IntegerType: pa.int32(),
        T.LongType: pa.int64(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BooleanType: pa.bool_(),
    }
    arrays = [pa.array(col, types[type(f.dataType)]) for col, f in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, names=schema.fieldNames()), schema)
