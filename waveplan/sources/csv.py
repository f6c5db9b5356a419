"""Drops as CSV files, one drop per file."""

from __future__ import annotations

import codecs
import csv
import io
import re
import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveplan.functions.text import clean_headers, clean_name
from waveplan.schema import DROPS
from waveplan.sources.conform import CORRUPT, DATE_FORMATS, conform

#: Bytes of a file that are read for its header, and files read at a time.
BLOCK, READERS = 1 << 16, 16

def source_file() -> Column:
    """Whole path of the row's file, which names its drop; the metadata column is percent-encoded."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def text_schema(header: list[str]) -> T.StructType:
    """Every column as text, plus the line itself where it has too few or many fields."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])


def csv_options(multi_line: bool) -> dict[str, str]:
    return {
        "header": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "multiLine": str(multi_line).lower(),
    }


def typed_drops(raw: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Rows with clean headers, ``drop_id`` from the file's path, and typed columns."""
    return conform(clean_headers(raw.withColumn("drop_id", source_file())), formats)


def record_end(data: str, multi_line: bool) -> int | None:
    """Where the first record ends, or None if it goes on; line breaks inside quotes belong to it."""
    quotes, seen = 0, 0
    for line_break in re.finditer("[\r\n]", data):
        quotes += data.count('"', seen, line_break.start())
        seen = line_break.start()
        if not multi_line or quotes % 2 == 0:
            return seen
    return None


def first_record(spark: SparkSession, file: str, multi_line: bool) -> str | None:
    """The first record of a file, of which as many blocks are read as it needs; None for an empty file."""
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    if codec is not None:
        stream = codec.createInputStream(stream)
    data, decoder = "", codecs.getincrementaldecoder("utf-8")("replace")
    try:
        while True:
            block = bytes(stream.readNBytes(BLOCK))
            data += decoder.decode(block, final=len(block) < BLOCK)
            end = record_end(data, multi_line)
            if end is not None or len(block) < BLOCK:
                return data[:end] if data else None
    finally:
        stream.close()


def file_headers(spark: SparkSession, path: str | list[str], multi_line: bool) -> dict[str, list[str]]:
    """The files under ``path`` by their first record.

    Spark lists the files, without reading them; then the first block of each is read, several at a time. The
    list of files is as long as the listing that Spark itself holds on the driver.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    with ThreadPoolExecutor(READERS) as pool:
        records = pool.map(lambda file: first_record(spark, file, multi_line), files)
        headers: dict[str, list[str]] = {}
        for file, record in zip(files, records):
            if record is not None:
                headers.setdefault(record, []).append(file)
    return {record: sorted(found) for record, found in headers.items()}


def scan_files(
    spark: SparkSession,
    path: str | list[str],
    formats: tuple[str, ...] = DATE_FORMATS,
    multi_line: bool = False,
) -> tuple[DataFrame | None, DataFrame]:
    """Rows of all files under ``path``, and the files that lack columns (file, missing).

    Columns are found by their name in each file, whatever their order; further columns of
    one file are null for the others. There are no rows if no file has all columns.
    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    drops, bad = None, []
    needed = [f.name for f in DROPS if f.name != "drop_id"]
    for record, files in sorted(file_headers(spark, path, multi_line).items()):
        header = next(csv.reader(io.StringIO(record.lstrip("\ufeff"))), [])
        missing = [c for c in needed if c not in [clean_name(h) for h in header]]
        if missing:
            bad += [(file, ", ".join(missing)) for file in files]
            continue
        raw = spark.read.options(**csv_options(multi_line)).schema(text_schema(header)).csv(files)
        rows = typed_drops(raw, formats)
        drops = rows if drops is None else drops.unionByName(rows, allowMissingColumns=True)
    return drops, spark.createDataFrame(bad, "file string, missing string")


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    formats: tuple[str, ...] = DATE_FORMATS,
    multi_line: bool = False,
) -> DataFrame:
    """The rows of :func:`scan_files`, with a warning for each file that cannot be used."""
    drops, bad = scan_files(spark, path, formats, multi_line)
    faults = [f"{r['file']} lacks the columns {r['missing']}" for r in bad.collect()]
    if drops is None:
        raise ValueError("; ".join(faults) or f"no files under {path}")
    for fault in faults:
        warnings.warn(fault, stacklevel=2)
    return drops
