"""Splitting rows that cannot be planned from rows that can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waveplan.schema import DIMENSIONS, QUANTITIES
from waveplan.session import materialize

KEYS = ["drop_id", "Distro", "SSZ", "DPCI"]
REASON = "reject_reason"
# Set by file scans.
MARKS = ["bad_line", "bad_date"]
REQUIRED = [*KEYS, "UnitSortable"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the input; null is the only missing value downstream."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def row_reason(columns: list[str]) -> Column:
    """First fault a row shows by itself, else null."""
    missing = F.lit(False)
    for name in REQUIRED:
        if name in columns:
            missing = missing | F.col(name).isNull()
    quantity = F.col("SSPsinVCP").isNull() | (F.col("SSPsinVCP") <= 0)
    for name in QUANTITIES[2:]:
        quantity = quantity | F.col(name).isNull() | (F.col(name) < 0)
    size = F.lit(False)
    for name in DIMENSIONS:
        size = size | F.col(name).isNull() | (F.col(name) <= 0)
    reason = F.when(missing, "missing_key")
    if "bad_line" in columns:
        reason = F.when(F.col("bad_line"), "bad_line").when(missing, "missing_key")
    if "bad_date" in columns:
        reason = reason.when(F.col("bad_date"), "bad_date")
    return reason.when(quantity, "bad_quantity").when(size, "bad_dimension")


def tag(drops: DataFrame, check_duplicates: bool = True) -> DataFrame:
    """Every input row with ``reject_reason``; null means the row can be planned.

    Copies of one key are all set aside, since none can be trusted over the others.
    Repeated keys are counted with a partial aggregate, so a key that fills a third of
    the table travels as one row per task; adaptive execution joins the usual short list
    without shuffling the rows.
    """
    rows = nan_to_null(drops).withColumn(REASON, row_reason(drops.columns))
    if not check_duplicates:
        return rows
    repeated = (
        rows.filter(F.col(REASON).isNull())
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") > 1)
    )
    tagged = rows.join(repeated, KEYS, "left")
    reason = F.coalesce(F.col(REASON), F.when(F.col("_copies").isNotNull(), "duplicate_key"))
    return tagged.select(*[F.col(c) for c in drops.columns], reason.alias(REASON))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be planned, without the marks of the checks, and the rejects."""
    good = tagged.filter(F.col(REASON).isNull()).drop(REASON, *MARKS)
    return good, tagged.filter(F.col(REASON).isNotNull())


def checked(drops: DataFrame, check_duplicates: bool = True, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The same two parts, tagged once: the verdict is a partition of one written table, so each
    part reads its own files. Also the number of rows and of rejects, counted while writing.

    The input is read twice: for repeated keys, and to be written. Columns are written by their place, so names may be
    any that a table can hold.
    """
    tagged = tag(drops, check_duplicates)
    names = tagged.columns
    seen = Observation()
    rows = tagged.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("planned", F.col(f"c{len(names) - 1}").isNull())
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("planned")).alias("rejects"))
    written = materialize(rows, "checked", paths, partition_by="planned")
    good, bad = (written.filter(c).drop("planned").toDF(*names) for c in (F.col("planned"), ~F.col("planned")))
    return good.drop(REASON, *MARKS), bad, {name: int(value or 0) for name, value in seen.get.items()}


def accepted(drops: DataFrame, check_duplicates: bool = True) -> DataFrame:
    return split(tag(drops, check_duplicates))[0]


def rejects(drops: DataFrame, check_duplicates: bool = True) -> DataFrame:
    return split(tag(drops, check_duplicates))[1]
