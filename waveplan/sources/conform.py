"""Typed ``drops`` columns from text, with extra columns passed through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveplan.schema import DROPS

# Holds a line with too few or too many fields.
CORRUPT = "_corrupt_record"
# Tried in turn after ISO dates.
DATE_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "M/d/yy", "yyyyMMdd")


def to_number(text: Column) -> Column:
    """Whole numbers written as ``3`` or ``3.0``; anything else is null."""
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))


def to_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(text.try_cast("timestamp_ntz"), *tries)


def conform(raw: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """All columns of ``DROPS`` in their types; a date that cannot be read sets ``bad_date``,
    a line with too few or too many fields ``bad_line``.

    Values that cannot be read become null, so the quality checks set their rows aside.
    """
    missing = [f.name for f in DROPS if f.name not in raw.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}")
    columns = []
    for field in DROPS:
        text = F.trim(F.col(field.name).cast("string"))
        if isinstance(field.dataType, T.StringType):
            value = F.col(field.name).cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            value = text.try_cast("double")
        elif isinstance(field.dataType, T.TimestampNTZType):
            value = to_date(text, formats)
        else:
            value = to_number(text).try_cast(field.dataType)
        columns.append(value.alias(field.name))
    given = F.trim(F.col("AllocationRequestDate").cast("string"))
    bad_date = (F.length(given) > 0) & to_date(given, formats).isNull()
    extras = [F.col(f"`{c}`") for c in raw.columns if c not in (*DROPS.fieldNames(), CORRUPT)]
    marks = [F.coalesce(bad_date, F.lit(False)).alias("bad_date")]
    if CORRUPT in raw.columns:
        marks.append(F.col(CORRUPT).isNotNull().alias("bad_line"))
    return raw.select(*columns, *extras, *marks)
