"""Comparing many scenarios without expanding rows by scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveplan.operators.capacity import METHODS, Scenario, capacities
from waveplan.operators.cartons import running_cartons, zone_ends
from waveplan.operators.running import CELL_ROWS
from waveplan.schema import GROUP
from waveplan.sources.aisles import aisle_rows

CAPS = (0.8, 0.9, 1.0)


def all_scenarios() -> list[Scenario]:
    """Every choice the parameters allow for aisles that hold cartons."""
    return [
        Scenario(udc, aisle, cap, method, level_a)
        for udc, aisle, _, _, carton in aisle_rows()
        if carton > 0
        for cap in CAPS
        for method in METHODS
        for level_a in (False, True)
    ]


def scenario_sweep(
    drops: DataFrame,
    scenarios: list[Scenario],
    aisles: DataFrame | None = None,
    rank_scope: str = "all_zones",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Waves and last-wave fill per zone and scenario; zones, not rows, meet the scenarios."""
    capacity = capacities(drops.sparkSession, scenarios, aisles)
    methods = sorted({s.method for s in scenarios})
    ends = zone_ends(running_cartons(drops, methods, rank_scope, cell_rows), capacity)
    return ends.select(
        *GROUP, "UDC", "Aisle_No", "Cap", "Method", "Level_A", "carton_size", "zone_locations", "n_waves", "last_wave_fill"
    )


def scenario_best(sweep: DataFrame) -> DataFrame:
    """Best aisle per zone and policy: fewest waves, fullest last wave, lowest number."""
    policy = [*GROUP, "UDC", "Cap", "Method", "Level_A"]
    # A partition holds the aisles of one centre.
    order = Window.partitionBy(*policy).orderBy(
        F.col("n_waves").asc(),
        (F.col("last_wave_fill") / F.col("carton_size")).desc(),
        F.col("Aisle_No").asc(),
    )
    return (
        sweep.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).drop("_place")
    )
