"""Contents and utilisation of every wave."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveplan.functions.text import percent_text, wave_label
from waveplan.operators.running import BEFORE, PLACE, UPTO
from waveplan.schema import GROUP

# Fixed value: locations added to the practical ones in the utilisation.
SPARE_LOCATIONS = 5


WAVE = [*GROUP, "Method", "scenario_id"]
SUMS = ["Total_plts", "Total_plts_ssps", "Total_vcp", "Total_loose_ssp", "Total_ssp", "Total_distro", "Total_CandB_locs"]
#: An item that is counted for itself; null in totals of items that stand in one place only.
SHARED = "_item"
#: Tasks that count the items of one wave, at most.
SHARES = 16
ITEM_BEFORE = "_item_before"


def _sums() -> list[Column]:
    on_pallets = F.when(F.col("TotalNumberofPallets") > 0, F.col("TotalNumberofFullVCPs"))
    totals = [
        F.sum("TotalNumberofPallets"),
        F.sum(on_pallets),
        F.sum("TotalNumberofFullVCPs"),
        F.sum("TotalNumberofLooseSSP"),
        F.sum("TotalNumberofSSPsintheDistro"),
        F.count("Distro"),
        F.sum("Total_locs"),
    ]
    return [F.coalesce(total, F.lit(0)).cast("bigint").alias(name) for name, total in zip(SUMS, totals)]


def _again() -> list[Column]:
    return [F.sum(name).alias(name) for name in SUMS]


def _place(rows: DataFrame) -> list[str]:
    return [c for c in PLACE if c in rows.columns]


def with_item_before(running: DataFrame, *also: str, methods: list[str] | None = None) -> DataFrame:
    """Rows with ``ITEM_BEFORE``, the running locations of their item's row before in the zone or part of it.

    Waves follow from running locations, so an item's rows that come in the order of these tell where it is new in
    a wave, under any scenario. Rows are where their zone or part is. ``methods``: rows hold the running locations
    of each (see ``cartons.carton_running``) and get a column for each; these sums grow in one order, so rows are sorted once.
    """
    if methods:
        sums = [f"_cum_{m}" for m in methods]
        order = Window.partitionBy("DPCI", *GROUP, *_place(running), *also).orderBy(*sums)
        return running.withColumns({f"{ITEM_BEFORE}_{m}": F.lag(c).over(order) for m, c in zip(methods, sums)})
    group = Window.partitionBy("DPCI", *GROUP, *_place(running), "Method", *also)
    return running.withColumn(ITEM_BEFORE, F.lag("wave_cum_locations").over(group.orderBy("wave_cum_locations")))


def carton_totals(waved: DataFrame) -> DataFrame:
    """Totals per carton wave, aggregated where the rows of a zone or part of it already are.

    An item is counted in place if all its rows of the wave must be there: the wave does not reach
    beyond the part (its number is above that of what comes before, and below that of the part's
    end), and the item has no pallets (``on_pallets``), which could join the wave later: it counts in its
    first row of the wave (see :func:`with_item_before`). For the others a row per wave and item (``SHARED``)
    is kept, so that each is counted once.
    """
    waved = waved if ITEM_BEFORE in waved.columns else with_item_before(waved, "scenario_id")
    size, alone = F.col("carton_size"), ~F.coalesce(F.col("on_pallets"), F.lit(False))
    if _place(waved):
        alone = alone & (F.col("wave_no") > F.ceil(F.col(BEFORE) / size)) & (F.col("wave_no") < F.ceil(F.col(UPTO) / size))
    new = F.coalesce(F.ceil(F.col(ITEM_BEFORE) / size) < F.col("wave_no"), F.lit(True))
    items = F.sum((alone & new & F.col("DPCI").isNotNull()).cast("bigint")).alias("_items")
    return waved.groupBy(*WAVE, "wave_no", F.when(~alone, F.col("DPCI")).alias(SHARED)).agg(*_sums(), items)


def totals_beside(waved: DataFrame, scenarios: DataFrame, beside: int, apart: bool = False) -> DataFrame:
    """The same as :func:`carton_totals` of rows that have their wave under each scenario of a lot in a slot
    (``cartons.waves_beside``).

    Rows of a part that are in one wave under each of these scenarios are added up first, so sums, not rows, are multiplied by scenarios.
    Items that are not counted in place under one of them stay apart there. ``apart``: where parts are smaller than
    waves, no item is counted in place; its rows of one part and wave are added up there and move no more.
    """
    slots = range(beside)
    stacked = F.lit(False) if apart else F.coalesce(F.col("on_pallets"), F.lit(False))

    def alone(j: int) -> Column:
        if apart:
            return F.lit(False)
        size, wave = F.col(f"_size_{j}"), F.col(f"_wave_{j}")
        inside = (wave > F.ceil(F.col(BEFORE) / size)) & (wave < F.ceil(F.col(UPTO) / size)) if _place(waved) else F.lit(True)
        return F.coalesce(~stacked & inside, F.lit(True))  # an empty slot keeps nothing apart

    waved = waved.withColumns({f"_alone_{j}": alone(j) for j in slots})
    every = reduce(and_, [F.col(f"_alone_{j}") for j in slots])
    new = [
        F.lit(False) if apart else F.coalesce(F.ceil(F.col(ITEM_BEFORE) / F.col(f"_size_{j}")) < F.col(f"_wave_{j}"), F.lit(True))
        for j in slots
    ]
    items = [F.sum((F.col(f"_alone_{j}") & new[j] & F.col("DPCI").isNotNull()).cast("bigint")).alias(f"_items_{j}") for j in slots]
    keys = [*GROUP, *_place(waved), "Method", "_lot", *[f"{c}_{j}" for c in ("_wave", "_alone") for j in slots]]
    added = waved.groupBy(*keys, F.when(~every, F.col("DPCI")).alias(SHARED)).agg(*_sums(), *items)
    each = [
        F.struct(
            F.lit(j).alias("_slot"),
            F.col(f"_wave_{j}").alias("wave_no"),
            F.when(~F.col(f"_alone_{j}"), F.col(SHARED)).alias(SHARED),
            F.col(f"_items_{j}").alias("_items"),
        )
        for j in slots
    ]
    own = [*GROUP, "Method", "_lot", *SUMS]
    rows = added.select(*own, F.explode(F.array(*each)).alias("_of")).select(*own, "_of.*")
    rows = rows.join(F.broadcast(scenarios.select("Method", "_lot", "_slot", "scenario_id")), ["Method", "_lot", "_slot"])
    if apart:
        return rows.select(*WAVE, "wave_no", SHARED, *SUMS, "_items")
    return rows.groupBy(*WAVE, "wave_no", SHARED).agg(*_again(), F.sum("_items").alias("_items"))


def carton_ends(totals: DataFrame) -> DataFrame:
    """Number and fill of the last carton wave of each zone and scenario, from the totals of its waves."""
    waves = totals.groupBy(*WAVE, "wave_no").agg(F.sum("Total_CandB_locs").alias("fill"))
    return waves.groupBy(*WAVE).agg(
        F.max("wave_no").alias("n_waves"), F.max_by("fill", "wave_no").alias("last_wave_fill")
    )


def wave_summary(cartons: DataFrame, pallets: DataFrame) -> DataFrame:
    """Totals per wave from :func:`carton_totals` and assigned pallet rows; sums over nothing are 0.

    Items of cartons that are counted for themselves move without sums, once, with all of a wave to ``SHARES`` tasks at most.
    """
    wave, packed = [*WAVE, "wave_id"], F.struct(*SUMS).alias("_sums")
    label = wave_label("W", F.col("wave_no")).alias("wave_id")
    in_place = F.sum(F.when(F.col(SHARED).isNull(), F.col("_items"))).alias("_items")
    boxes = cartons.groupBy(*WAVE, "wave_no").agg(*_again(), in_place).select(*WAVE, label, packed, "_items")
    named = cartons.filter(F.col(SHARED).isNotNull()).select(*WAVE, label, SHARED)
    rows = pallets.groupBy(*wave, F.col("DPCI").alias(SHARED)).agg(*_sums(), F.count("DPCI").alias("_items"))
    moved = rows.select(*wave, SHARED, packed, "_items").unionByName(boxes, True).unionByName(named, True)
    moved = moved.withColumn("_share", F.pmod(F.xxhash64(SHARED), F.lit(SHARES))).repartition(*wave, "_share")
    again = [F.sum(f"_sums.{name}").alias(name) for name in SUMS]
    items = moved.groupBy(*wave, "_share", SHARED).agg(*again, F.sum("_items").alias("_items"))
    number = F.when(F.col(SHARED).isNull(), F.col("_items")).otherwise(F.lit(1))
    return items.groupBy(*wave).agg(*_again(), F.sum(number).alias("Total_dpci")).drop("Method")


def wave_utilisation(summary: DataFrame, capacity: DataFrame) -> DataFrame:
    """The summary with the share of the aisle each wave uses, as number and text.

    The aisle's pallet locations count as used in every wave.
    """
    used = F.col("Total_CandB_locs") + F.col("pallet_size")
    share = used / (F.col("practical_locations") + SPARE_LOCATIONS)
    columns = capacity.select("scenario_id", "pallet_size", "practical_locations")
    return (
        summary.join(F.broadcast(columns), "scenario_id")
        .withColumn("Aisle_utilz", share)
        .withColumn("Aisle_utilz_text", percent_text(F.col("Aisle_utilz")))
        .drop("pallet_size", "practical_locations")
    )
