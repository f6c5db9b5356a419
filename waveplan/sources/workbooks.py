"""Drops as workbooks, one drop per file."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveplan.schema import DROPS
from waveplan.sources.conform import DATE_FORMATS, conform

# Where a workbook keeps its rows.
SHEET = "DistroData"
HEADER_ROW = 6

Decoder = Callable[[bytes], pd.DataFrame]
CHUNK = 10_000


def read_sheet(content: bytes) -> pd.DataFrame:
    """The sheet through pandas; needs an Excel engine on the executors."""
    return pd.read_excel(
        io.BytesIO(content),
        sheet_name=SHEET,
        header=HEADER_ROW - 1,
        dtype=object,
        converters={"Distro": str, "DPCI": str},
    )


def scan_workbooks(
    spark: SparkSession,
    path: str,
    decoder: Decoder = read_sheet,
    extra_columns: tuple[str, ...] = (),
    formats: tuple[str, ...] = DATE_FORMATS,
) -> DataFrame:
    """One task decodes one file at a time; a sheet has at most about a million rows.

    ``extra_columns`` names further columns to pass through as text.
    """
    names = [f.name for f in DROPS if f.name != "drop_id"] + list(extra_columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["file_name", *names]])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"]):
                sheet = decoder(content)
                sheet.columns = ["".join(str(c).split()) for c in sheet.columns]
                for start in range(0, len(sheet), CHUNK):
                    rows = sheet.iloc[start : start + CHUNK].reindex(columns=names)
                    text = rows.astype("string").astype(object).where(rows.notna(), None)
                    text.insert(0, "file_name", name)
                    yield text

    files = spark.read.format("binaryFile").load(path)
    raw = files.select(F.col("path").alias("file_name"), "content").mapInPandas(
        decode, schema
    )
    named = raw.withColumnRenamed("file_name", "drop_id")
    return conform(named, formats)
