"""Pallet items in release order and the running locations they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveplan.functions.text import wave_label
from waveplan.operators.filters import pallet_rows
from waveplan.operators.running import CELL_ROWS, Order, running_sum, split
from waveplan.schema import GROUP, ITEM

# Fixed value: pallets that share one pallet location.
PALLETS_PER_LOCATION = 3


def pallet_rollup(drops: DataFrame) -> DataFrame:
    """Pallets, cartons and mean carton height per item.

    The height is summed as a decimal: the mean orders items, so it must not depend on
    the order in which tasks finish.
    """
    height = F.sum(F.col("VCPHeight").cast("decimal(20,8)")).cast("double")
    return (
        pallet_rows(drops)
        .groupBy(*ITEM)
        .agg(
            F.sum("TotalNumberofPallets").alias("pallets"),
            F.sum("TotalNumberofFullVCPs").alias("vcp"),
            (height / F.count("VCPHeight")).alias("VCPHt"),
        )
    )


MOST_CARTONS = Order("vcp", "VCPHt", "DPCI", descending=("vcp", "VCPHt"))


def pallet_running(
    rollup: DataFrame, cell_rows: int = CELL_ROWS, paths: list[str] | None = None, total: int | None = None
) -> DataFrame:
    """Running pallet locations per zone, items with most cartons first; ``total`` is the number of items or more."""
    located = rollup.withColumn("pallet_loc", F.ceil(F.col("pallets") / PALLETS_PER_LOCATION))
    parts = split(rollup, GROUP, MOST_CARTONS, cell_rows, paths, total)
    return running_sum(located, GROUP, MOST_CARTONS, "pallet_loc", "pallet_cum_locations", parts=parts)


def pallet_wave_number(size: str = "pallet_size") -> Column:
    return F.ceil(F.col("pallet_cum_locations") / F.col(size))


def pallet_waves(running: DataFrame, capacity: DataFrame, methods: list[str]) -> DataFrame:
    """Pallet items with their wave under every scenario."""
    return (
        running.withColumn("Method", F.explode(F.array(*[F.lit(m) for m in methods])))
        .join(F.broadcast(capacity), "Method")
        .withColumn("wave_no", pallet_wave_number())
        .withColumn("wave_id", wave_label("W", F.col("wave_no")))
    )
