"""Planning drop files as they arrive.

A drop is complete in its file, and the file source never splits a file over batches,
so every batch holds whole drops and can be planned like any table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waveplan.operators.capacity import Scenario
from waveplan.plans.planner import Rules, plan_waves
from waveplan.sources.csv import scan_files

#: A file of the inbox as the source lists it.
FILE = "path string, modificationTime timestamp, length long, content binary"


def plan_uploads(
    spark: SparkSession,
    inbox: str,
    outbox: str,
    checkpoint: str,
    scenarios: list[Scenario],
    rules: Rules | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Plan every new CSV under ``inbox``; stops when all present files are done.

    The stream tells which files are new; a batch of at most ``files_per_batch`` files is
    read by header like any scan, so a file that lacks columns is listed in ``bad_files``
    and holds up no other. A batch is written to folders named after its number, so a batch
    that is run again after a failure replaces its own output.
    """
    # only names are selected, so the contents are not read here
    listed = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch)

    def plan(batch: DataFrame, number: int) -> None:
        files = sorted(r["file"] for r in batch.distinct().collect())  # at most files_per_batch
        if not files:
            return
        drops, bad = scan_files(spark, files)
        tables = {"bad_files": bad}
        if drops is not None:
            waves = plan_waves(drops, scenarios, rules=rules)
            tables |= {"assigned": waves.assigned, "summary": waves.wave_summary, "rejects": waves.rejects}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{outbox}/{name}/batch={number}")
        if drops is not None:
            waves.close()

    return (
        listed.load(inbox)
        .select(F.col("path").alias("file"))
        .writeStream.foreachBatch(plan)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
