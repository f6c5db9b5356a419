"""Named queries over the star-schema tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveplan.functions import locations
from waveplan.functions.text import charging_instructions
from waveplan.operators import cartons, filters, items, pallets, quality
from waveplan.operators.capacity import METHODS, Scenario, capacities
from waveplan.plans.planner import Rules, WavePlan
from waveplan.plans.scenarios import all_scenarios, scenario_best, scenario_sweep
from waveplan.schema import GROUP, ITEM
from waveplan.sources.aisles import aisles
from waveplan.sources.conform import conform
from waveplan.sources.star import FAULTY_COLUMNS, STACKED_COLUMNS, drops

Query = Callable[[SparkSession, str], DataFrame]

DEFAULT = Scenario(3840, 2)
SCENARIOS = [
    DEFAULT,
    Scenario(3840, 2, 0.9, "DPCI"),
    Scenario(3842, 2, 0.9, "Distro"),
    Scenario(3842, 12, 1.0, "DPCI"),
    Scenario(3842, 5, 0.8, "Distro", True),
    Scenario(3842, 13, 0.9, "DPCI", True),
    Scenario(3841, 7, 0.9, "Distro", True),
]
#: Far below the rows of a zone at any scale.
ROWS_OF_A_PART = 50
# The last three cannot be planned: two pallet-only aisles, one unknown.
LOOKUPS = [*SCENARIOS, Scenario(3840, 1), Scenario(3841, 14), Scenario(3841, 1)]
WRITTEN = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyyMMdd")
DATES = (datetime(1996, 3, 1), datetime(1998, 9, 30))

# The derived view has one row per Distro and no faults, so these queries plan it as it
# is; ``plan_waves`` adds the checks for other input.


def _plan(spark: SparkSession, sf_dir: str, scenarios: list[Scenario], **rules) -> WavePlan:
    return WavePlan(drops(spark, sf_dir), scenarios, rules=Rules(**rules))


def scan_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drops(spark, sf_dir)


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.preview(drops(spark, sf_dir))


def distro_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.prepare(drops(spark, sf_dir))


def filter_unit_sortable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.unit_sortable(drops(spark, sf_dir), "Y")


def non_pallet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.non_pallet(drops(spark, sf_dir))


def pallet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pallet_rows(drops(spark, sf_dir))


def carton_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.carton_rows(drops(spark, sf_dir), zone=9)


def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.date_range(drops(spark, sf_dir), *DATES)


def domain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.domain_values(drops(spark, sf_dir), aisles(spark))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulty = drops(spark, sf_dir, FAULTY_COLUMNS)
    return quality.rejects(faulty).select("drop_id", "Distro", "DPCI", "SSZ", "UnitSortable", quality.REASON)


def accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted(drops(spark, sf_dir, FAULTY_COLUMNS))


def dims_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locations.with_axes(drops(spark, sf_dir), "VCPHeight", "VCPWidth", "VCPLength")
    return rows.select("Distro", *locations.AXES)


def slot_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locations.with_axes(drops(spark, sf_dir), "VCPHeight", "VCPWidth", "VCPLength")
    return locations.with_geometry(rows).select("Distro", *locations.GEOMETRY)


def distro_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locations.distro_locations(drops(spark, sf_dir))
    return rows.select("Distro", "SSZ", "DPCI", "Ratio", *locations.FIT, "Total_locs")


def dpci_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.item_rollup(drops(spark, sf_dir))


def dpci_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = items.item_locations(drops(spark, sf_dir))
    return sized.select(*ITEM, "vcp", "Ratio", *locations.AXES, *locations.GEOMETRY, *locations.FIT, "Total_locs")


def dpci_locs_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.join_item_locations(drops(spark, sf_dir)).select("Distro", *ITEM, "Total_locs")


def dpci_first_distro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.first_distro_masked(drops(spark, sf_dir)).select("Distro", *ITEM, "rank", "Total_locs")


def dpci_first_distro_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.first_distro_masked(drops(spark, sf_dir), "zone").select("Distro", *ITEM, "rank", "Total_locs")


def method_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cartons.sized_cartons(drops(spark, sf_dir), list(METHODS))
    return sized.select("Method", "Distro", *ITEM, "Total_locs")


def capacity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carton locations of every zone next to the sizes of each scenario."""
    sized = cartons.sized_cartons(drops(spark, sf_dir), list(METHODS))
    zones = sized.groupBy(*cartons.RUN).agg(F.sum("Total_locs").alias("zone_locations"))
    return zones.join(F.broadcast(capacities(spark, LOOKUPS)), "Method")


def carton_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = cartons.running_cartons(drops(spark, sf_dir), ["Distro"])
    return running.select("Distro", *GROUP, "Total_locs", "wave_cum_locations")


def carton_running_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums with few rows a task, so that zones, days and aisles are cut into parts."""
    running = cartons.running_cartons(drops(spark, sf_dir), ["Distro"], cell_rows=4)
    return running.select("Distro", *GROUP, "Total_locs", "wave_cum_locations")


def carton_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = _plan(spark, sf_dir, SCENARIOS).carton_waves
    return waves.select("scenario_id", "Distro", *GROUP, "Total_locs", "wave_no", "wave_id")


def last_wave_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir, SCENARIOS)
    return cartons.last_waves(plan.carton_waves).select("scenario_id", *GROUP, "last_wave", "last_fill")


def pallet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pallets.pallet_rollup(drops(spark, sf_dir))


def pallet_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir, [DEFAULT])
    columns = [*ITEM, "pallets", "vcp", "VCPHt", "pallet_loc", "pallet_cum_locations", "wave_no", "wave_id"]
    return plan.pallet_waves.select(*columns)


def wave_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last carton and last pallet wave per zone; null where there is none."""
    plan = _plan(spark, sf_dir, [DEFAULT])
    keys = [*GROUP, "scenario_id"]
    last_pallet = plan.pallet_waves.groupBy(*keys).agg(F.max("wave_no").alias("last_pallet_wave"))
    last_carton = cartons.last_waves(plan.carton_waves).select(*keys, F.col("last_wave").alias("last_carton_wave"))
    return last_carton.join(last_pallet, keys, "full")


def pallet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, SCENARIOS).placed_pallets.select(
        "scenario_id",
        "Distro",
        *GROUP,
        "pallet_wave_no",
        F.col("wave_no").alias("last_wave"),
        "placement",
    )


def pallet_trailing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to the trailing pallets of each zone."""
    placed = _plan(spark, sf_dir, SCENARIOS).placed_pallets
    trailing = placed.filter(F.col("placement").isin("own", "last", "extra"))
    return trailing.groupBy("scenario_id", *GROUP, "placement").agg(
        F.max("trailing_pallets").alias("trailing_pallets"), F.count("Distro").alias("rows")
    )


def pallet_trailing_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plan(spark, sf_dir, SCENARIOS).assigned
    few = rows.filter((F.col("TotalNumberofPallets") > 0) & F.col("Total_locs").isNotNull())
    return few.select("scenario_id", "Distro", *GROUP, "Aisle", "Total_locs", "wave_id")


def charging(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = charging_instructions(F.col("VCPHeight")).alias("Charging Instructions")
    return drops(spark, sf_dir).select("Distro", "VCPHeight", label)


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request dates written as text, in a form that changes by row, and read back."""
    form = F.pmod(F.col("Aisle"), F.lit(len(WRITTEN) + 2))
    text = F.when(form == len(WRITTEN), F.lit("soon")).when(form == len(WRITTEN) + 1, F.lit(" "))
    for k, pattern in enumerate(WRITTEN):
        text = text.when(form == k, F.date_format("AllocationRequestDate", pattern))
    rows = drops(spark, sf_dir).withColumn("AllocationRequestDate", text.cast("string"))
    return conform(rows).select("Distro", "AllocationRequestDate", "bad_date")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plan(spark, sf_dir, SCENARIOS).assigned
    return rows.select("scenario_id", "Distro", *ITEM, "Total_locs", "wave_id", "Charging Instructions")


def export_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, [DEFAULT]).assigned.drop("scenario_id")


def assigned_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with so few rows a task that zones and days are cut into parts."""
    rows = _plan(spark, sf_dir, SCENARIOS[:2], cell_rows=ROWS_OF_A_PART).assigned
    return rows.select("scenario_id", "Distro", *ITEM, "Total_locs", "wave_id", "Charging Instructions")


def pallet_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final waves where some zones have no cartons, so that all their pallets trail."""
    rows = WavePlan(drops(spark, sf_dir, STACKED_COLUMNS), SCENARIOS[:3]).assigned
    return rows.select("scenario_id", "Distro", *ITEM, "TotalNumberofPallets", "Total_locs", "wave_id")


def wave_summary_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary with so few rows a task that waves reach over parts."""
    return _plan(spark, sf_dir, SCENARIOS[:2], cell_rows=ROWS_OF_A_PART).wave_summary.drop("Aisle_utilz_text")


def wave_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, [DEFAULT]).wave_summary.drop("Aisle_utilz_text")


def wave_summary_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, SCENARIOS).wave_summary.drop("Aisle_utilz_text")


def wave_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _plan(spark, sf_dir, SCENARIOS[:2]).wave_summary
    return summary.select(
        "scenario_id", *GROUP, "wave_id", "Total_CandB_locs", "Aisle_utilz", "Aisle_utilz_text"
    )


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_sweep(drops(spark, sf_dir), all_scenarios())


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_best(sweep(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "scan_drops": scan_drops,
    "preview": preview,
    "distro_prep": distro_prep,
    "filter_unit_sortable": filter_unit_sortable,
    "non_pallet": non_pallet,
    "pallet_rows": pallet_rows,
    "carton_rows": carton_rows,
    "filter_date_range": filter_date_range,
    "domain_values": domain_values,
    "rejects": rejects,
    "accepted_rows": accepted_rows,
    "dims_canonical": dims_canonical,
    "slot_geometry": slot_geometry,
    "distro_locations": distro_locations,
    "dpci_rollup": dpci_rollup,
    "dpci_locations": dpci_locations,
    "dpci_locs_joined": dpci_locs_joined,
    "dpci_first_distro": dpci_first_distro,
    "dpci_first_distro_by_zone": dpci_first_distro_by_zone,
    "method_select": method_select,
    "capacity_lookup": capacity_lookup,
    "carton_running": carton_running,
    "carton_running_scaled": carton_running_scaled,
    "carton_waves": carton_waves,
    "last_wave_fill": last_wave_fill,
    "pallet_rollup": pallet_rollup,
    "pallet_waves": pallet_waves,
    "wave_limits": wave_limits,
    "pallet_split": pallet_split,
    "pallet_trailing_policy": pallet_trailing_policy,
    "pallet_trailing_small": pallet_trailing_small,
    "charging_instructions": charging,
    "date_texts": date_texts,
    "assigned": assigned,
    "assigned_in_parts": assigned_in_parts,
    "pallet_zones": pallet_zones,
    "wave_summary_in_parts": wave_summary_in_parts,
    "export_assigned": export_assigned,
    "wave_summary": wave_summary,
    "wave_summary_scenarios": wave_summary_scenarios,
    "wave_utilisation": wave_utilisation,
    "scenario_sweep": sweep,
    "scenario_best": best,
}
