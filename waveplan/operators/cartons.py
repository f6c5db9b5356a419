"""Carton waves: rows in release order, cut where the aisle is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveplan.functions.locations import with_distro_locs
from waveplan.functions.text import wave_label
from waveplan.operators.capacity import lots
from waveplan.operators.filters import non_pallet
from waveplan.operators.items import MARK, item_charges, with_charges
from waveplan.operators.running import BEFORE, CELL_ROWS, UPTO, Order, Parts, running_sum, split
from waveplan.schema import GROUP, ITEM, ITEM_GRAIN_ZONE

RUN = [*GROUP, "Method"]
RELEASE = Order("AllocationRequestDate", "Aisle", "Distro", ("DPCI", MARK))


def item_zone(methods: list[str]) -> int | None:
    """The zone whose rows are sized by item, or None for all of them."""
    return None if "DPCI" in methods else ITEM_GRAIN_ZONE


def release_rows(drops: DataFrame, charges: DataFrame, parts: Parts) -> DataFrame:
    """Non-pallet rows with ``_row_locs``, their locations at row grain, and before its row the charge of each item."""
    rows = with_distro_locs(non_pallet(drops), "_row_locs")
    return with_charges(rows, charges, [] if parts.levels else GROUP)


def _by_item(method: str) -> Column:
    """One zone is sized at item grain whatever the method."""
    return F.lit(True) if method == "DPCI" else F.coalesce(F.col("SSZ") == ITEM_GRAIN_ZONE, F.lit(False))


def carton_running(
    released: DataFrame, methods: list[str], parts: Parts, bounds: bool = False
) -> DataFrame:
    """Every row with its locations by each method, their running sum in the zone and the zone's; they depend
    on no aisle or cap. One order serves all methods. An unknown size counts as 1.

    Columns: ``_locs_``, ``_cum_`` and ``_zone_`` + method (see :func:`by_method`), and the bounds of ``running_sum``.
    """
    # what a row adds: its own size, or that of the item it is charged with, which stands in the row before
    amount = F.coalesce(F.when(F.col(MARK) == 0, F.col("_charge")).otherwise(F.col("_row_locs")), F.lit(1)).cast("bigint")
    sized = released.withColumns(
        {f"_size_{m}": F.when((F.col(MARK) == 0) == _by_item(m), amount).otherwise(F.lit(0).cast("bigint")) for m in methods}
        | {"_charged": F.when(F.col(MARK) == 0, F.coalesce("_charge", F.lit(1)))}
    )
    ran = running_sum(
        sized, GROUP, RELEASE, [f"_size_{m}" for m in methods], [f"_cum_{m}" for m in methods], parts=parts,
        total={f"_size_{m}": f"_zone_{m}" for m in methods}, before=("_charged",), bounds=bounds,
    ).filter(F.col(MARK) == 1)
    charged = F.coalesce(F.col("_last__charged"), F.lit(0)).cast("bigint")
    locations = {f"_locs_{m}": F.when(_by_item(m), charged).otherwise(F.col(f"_size_{m}")) for m in methods}
    return ran.withColumns(locations).drop("_row_locs", "_charge", "_charged", "_last__charged", MARK, *[f"_size_{m}" for m in methods])


def by_method(running: DataFrame, methods: list[str], bounds: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows once for each method, with ``Total_locs``, ``wave_cum_locations`` and ``zone_locations``, and ``also`` columns
    named by method."""
    named = {"Total_locs": "_locs_", "wave_cum_locations": "_cum_", "zone_locations": "_zone_"}
    if bounds:
        named |= {BEFORE: f"{BEFORE}_size_", UPTO: f"{UPTO}_size_"}
    named |= {column: f"{column}_" for column in also}
    used = [column + m for m in methods for column in named.values()]
    kinds = [F.struct(F.lit(m).alias("Method"), *[F.col(c + m).alias(name) for name, c in named.items()]) for m in methods]
    return running.withColumn("_by", F.explode(F.array(*kinds))).select(
        *[F.col(c) for c in running.columns if c not in used], "_by.*"
    )


def sized_cartons(drops: DataFrame, methods: list[str], rank_scope: str = "all_zones") -> DataFrame:
    """Non-pallet rows once for each method with the ``Total_locs`` they need, without any order."""
    rows = with_distro_locs(non_pallet(drops), "_row_locs")
    charges = item_charges(drops, rank_scope, item_zone(methods)).select(*ITEM, "Distro", "_charge", F.lit(True).alias("_is"))
    rows = rows.join(charges, [*ITEM, "Distro"], "left")
    charged = F.when(F.col("_is"), F.coalesce("_charge", F.lit(1))).otherwise(F.lit(0))
    at_item = (F.col("Method") == "DPCI") | (F.col("SSZ") == ITEM_GRAIN_ZONE)
    rows = rows.withColumn("Method", F.explode(F.array(*[F.lit(m) for m in methods])))
    locations = F.when(at_item, charged).otherwise(F.coalesce("_row_locs", F.lit(1))).cast("bigint")
    return rows.withColumn("Total_locs", locations).drop("_row_locs", "_charge", "_is")


def running_cartons(
    drops: DataFrame, methods: list[str], rank_scope: str = "all_zones", cell_rows: int = CELL_ROWS, paths: list[str] | None = None
) -> DataFrame:
    """Rows once for each method with their running locations, from the input alone."""
    parts = split(non_pallet(drops), GROUP, RELEASE, cell_rows, paths, drops.count())
    charges = item_charges(drops, rank_scope, item_zone(methods))
    return by_method(carton_running(release_rows(drops, charges, parts), methods, parts), methods)


def wave_number(cumulative: str = "wave_cum_locations", size: str = "carton_size") -> Column:
    """Wave of a running total: a row that crosses a boundary is in the later wave.

    Rows of size zero before the first sized row are in wave 0.
    """
    return F.ceil(F.col(cumulative) / F.col(size))


def carton_waves(running: DataFrame, capacity: DataFrame) -> DataFrame:
    """Carton rows with their wave under every scenario of their method."""
    # ``capacity`` has one row per scenario passed in.
    waved = running.drop("zone_locations").join(F.broadcast(capacity), "Method").withColumn("wave_no", wave_number())
    return waved.withColumn("wave_id", wave_label("W", F.col("wave_no")))


def waves_beside(running: DataFrame, scenarios: DataFrame, beside: int) -> DataFrame:
    """Carton rows once a lot of ``scenarios`` (``capacity.numbered`` by method), with size and wave in each slot (``_size_``,
    ``_wave_``): rows do not multiply by scenarios that stand beside each other."""
    sizes = lots(scenarios, beside, {"_size_": "carton_size"}, ["Method"])
    waved = running.drop("zone_locations").join(F.broadcast(sizes), "Method")
    return waved.withColumns({f"_wave_{j}": wave_number(size=f"_size_{j}") for j in range(beside)})


def last_waves(waves: DataFrame) -> DataFrame:
    """Number and fill of the last carton wave per zone and scenario, aggregated before moving."""
    keys = [*RUN, "scenario_id"]
    return (
        waves.groupBy(*keys, "wave_no")
        .agg(F.sum("Total_locs").alias("fill"))
        .groupBy(*keys)
        .agg(F.max("wave_no").alias("last_wave"), F.max_by("fill", "wave_no").alias("last_fill"))
    )


def zone_ends(running: DataFrame, capacity: DataFrame) -> DataFrame:
    """Total, number of waves and last-wave fill per zone and scenario, in one pass over the rows.

    The number of waves follows from the zone total. The last wave starts at the one row
    whose locations cross its lower bound, and that bound lies within one wave of the
    total: only rows that near the end are compared with the distinct wave sizes. A zone
    keeps at most one such row per size, so rows never multiply by scenarios.
    """
    # at most one size a scenario
    sizes = [r.carton_size for r in capacity.select("carton_size").distinct().orderBy("carton_size").collect()]
    total, upto = F.col("zone_locations"), F.col("wave_cum_locations")
    before = upto - F.col("Total_locs")
    listed = F.array(*[F.lit(s) for s in sizes]).cast("array<double>")
    near_end = (F.col("Total_locs") > 0) & (upto > total - F.lit(max(sizes, default=0.0)))
    crossed = F.filter(
        listed,
        lambda size: (F.ceil(upto / size) == F.ceil(total / size)) & (F.ceil(before / size) < F.ceil(total / size)),
    )
    start = F.struct((total - before).alias("fill"), F.col("_sizes").alias("sizes"))
    zones = (
        running.select(*RUN, "zone_locations", "wave_cum_locations", "Total_locs")
        .withColumn("_sizes", F.when(near_end, crossed))
        .groupBy(*RUN)
        .agg(
            F.max("zone_locations").alias("zone_locations"),
            F.collect_list(F.when(F.size("_sizes") > 0, start)).alias("_starts"),
        )
    )
    size = F.col("carton_size")
    matching = F.filter(F.col("_starts"), lambda start: F.array_contains(start["sizes"], size))
    # ``capacity`` has one row per scenario passed in.
    return (
        zones.join(F.broadcast(capacity), "Method")
        .withColumn("n_waves", F.ceil(total / size))
        .withColumn("last_wave_fill", F.coalesce(F.get(matching, F.lit(0))["fill"], F.lit(0)).cast("bigint"))
        .drop("_starts")
    )
