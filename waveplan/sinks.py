"""Writing plans as partitioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that readers of the folder skip.
STAGED, MANIFESTS, COMMITTED = "_staged", "_manifests", "_COMMITTED"


def write_assigned(
    assigned: DataFrame,
    path: str,
    file_format: str = "parquet",
    partition_by: tuple[str, ...] = ("drop_id", "SSZ"),
    mode: str = "errorifexists",
) -> None:
    """Write one folder per drop and zone, with all columns of ``assigned``.

    The rebalance hint lets adaptive execution gather small folders into few files and
    split a big zone over several tasks.
    """
    rows = assigned.hint("rebalance", *partition_by)
    writer = rows.write.mode(mode).partitionBy(*partition_by)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


class _Folder:
    """A folder on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def has(self, *names: str) -> bool:
        return self.fs.exists(self.at(*names))

    def names(self, *names: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(*names))) if self.has(*names) else []

    def files(self, *names: str) -> list[dict]:
        found, out = self.fs.listFiles(self.at(*names), True), []
        while found.hasNext():
            status = found.next()
            out.append({"file": status.getPath().toString().rsplit("/" + names[-1] + "/", 1)[1], "bytes": status.getLen()})
        return sorted(out, key=lambda f: f["file"])

    def write(self, text: str, *names: str) -> None:
        stream = self.fs.create(self.at(*names), True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        """Put source in the place of target."""
        self.fs.delete(self.at(*target), True)
        self.fs.mkdirs(self.at(*target).getParent())
        if not self.fs.rename(self.at(*source), self.at(*target)):
            raise OSError(f"{self.at(*source)} could not be moved to {self.at(*target)}")

    def delete(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)


def finish(spark: SparkSession, path: str) -> None:
    """Bring exports that were committed but not moved to the end, the oldest first."""
    folder = _Folder(spark, path)
    runs = [r for r in folder.names(STAGED) if folder.has(STAGED, r, COMMITTED)]
    for run in sorted(runs, key=lambda r: folder.fs.getFileStatus(folder.at(STAGED, r, COMMITTED)).getModificationTime()):
        for manifest in folder.names(STAGED, run, MANIFESTS):
            drop = manifest.removesuffix(".json")
            # what is no longer staged was moved before
            if folder.has(STAGED, run, drop):
                folder.move((STAGED, run, drop), (drop,))
            folder.move((STAGED, run, MANIFESTS, manifest), (MANIFESTS, manifest))
        folder.delete(STAGED, run)


def publish_assigned(
    assigned: DataFrame, path: str, file_format: str = "parquet", partition_by: tuple[str, ...] = ("drop_id", "SSZ")
) -> str:
    """Replace the drops of ``assigned`` under ``path`` by it, whole drop by whole drop; returns the run's name.

    Rows go to a staged folder that readers skip, then a manifest for each drop (run, rows and files),
    then a mark that commits the run. Only then drops are moved to their place, each over what a former run
    wrote. A run that fails before the mark changes nothing; one that fails behind it is finished by the
    next, or by :func:`finish`. So a drop is always of one run, and repeating a run leaves one result.
    Other drops stay as they are. ``partition_by`` starts with the drop.
    """
    spark, run = assigned.sparkSession, uuid.uuid4().hex
    finish(spark, path)
    folder = _Folder(spark, path)
    staged = f"{folder.root}/{STAGED}/{run}"
    write_assigned(assigned, staged, file_format, partition_by)
    # a folder per drop, as many as the listing of the output has
    drops = [name for name in folder.names(STAGED, run) if name.startswith(f"{partition_by[0]}=")]
    if drops:
        reader = spark.read.option("header", True) if file_format == "csv" else spark.read
        place = F.regexp_extract(F.col("_metadata.file_path"), f"/({partition_by[0]}=[^/]*)/", 1)
        counted = reader.format(file_format).load(staged).groupBy(F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))).alias("drop")).count()
        rows = {r["drop"]: r["count"] for r in counted.collect()}
    for name in drops:
        manifest = {"drop": name, "run": run, "rows": rows.get(name, 0), "files": folder.files(STAGED, run, name)}
        folder.write(json.dumps(manifest), STAGED, run, MANIFESTS, f"{name}.json")
    folder.write(run, STAGED, run, COMMITTED)
    finish(spark, path)
    return run


def clean_staged(spark: SparkSession, path: str) -> None:
    """Delete what failed runs have left; no export may be running."""
    finish(spark, path)
    _Folder(spark, path).delete(STAGED)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """drop, run, rows and files of every published drop."""
    return spark.read.schema("drop string, run string, rows long, files array<struct<file:string,bytes:long>>").json(
        f"{path.rstrip('/')}/{MANIFESTS}"
    )
