"""Row selections and small reports over ``drops``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveplan.schema import release_order


def unit_sortable(drops: DataFrame, value: str) -> DataFrame:
    return drops.filter(F.col("UnitSortable") == value)


def non_pallet(drops: DataFrame) -> DataFrame:
    return drops.filter(F.col("TotalNumberofPallets") == 0)


def pallet_rows(drops: DataFrame, zone: int | None = None) -> DataFrame:
    """Rows shipped on pallets; every zone at once unless one is named."""
    rows = drops.filter(F.col("TotalNumberofPallets") > 0)
    return rows if zone is None else rows.filter(F.col("SSZ") == zone)


def carton_rows(drops: DataFrame, zone: int | None = None) -> DataFrame:
    rows = non_pallet(drops)
    return rows if zone is None else rows.filter(F.col("SSZ") == zone)


def date_range(drops: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows requested from ``start`` to ``end``, both included."""
    day = F.col("AllocationRequestDate")
    low, high = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in (start, end))
    return drops.filter(day.between(low, high))


def preview(drops: DataFrame, rows: int = 5) -> DataFrame:
    """The first page of the table in release order."""
    return drops.orderBy(F.col("drop_id"), *release_order()).limit(rows)


def domain_values(drops: DataFrame, aisles: DataFrame) -> DataFrame:
    """The sorted choices of every parameter, as (domain, position, value) rows.

    One distinct over both columns of a table is tiny before it is split into two lists.
    """

    def choice(domain: str, number: Column) -> Column:
        return F.struct(
            F.lit(domain).alias("domain"), number.cast("bigint").alias("number"), F.col(domain).cast("string").alias("value")
        )

    def lists(table: DataFrame, *choices: Column) -> DataFrame:
        return table.select(F.explode(F.array(*choices)).alias("choice")).select("choice.*")

    rows = drops.select("SSZ", "UnitSortable").distinct()
    places = aisles.select("UDC", "Aisle_No")
    found = lists(rows, choice("SSZ", F.col("SSZ")), choice("UnitSortable", F.lit(None))).union(
        lists(places, choice("UDC", F.col("UDC")), choice("Aisle_No", F.col("Aisle_No")))
    )
    found = found.filter(F.col("value").isNotNull()).distinct()
    return found.orderBy("domain", "number", "value").drop("number")
