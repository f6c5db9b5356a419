"""Shelf locations needed by a quantity of one carton size.

Every helper takes and returns a DataFrame and adds plain projections, so both
grains (row and item) share the code and stay inside whole-stage codegen. Each step
is its own projection: later steps read a value, not a repeated expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shelf slot and stacking limits in inches.
SLOT_WIDTH = 15.5
SLOT_DEPTH = 92.5
STACK_LIMIT = 5
STACK_SPACE = 10
FIRST_STACK = 2
TRAY_SPACE = 7.7
LOOSE_BOX_RATIO = 0.5

AXES = ["Ht", "Wt", "Lt"]
GEOMETRY = ["Loc_wt", "Loc_lt", "Loc_ht1", "Loc_ht2", "Loc_tot"]
FIT = ["Loc_vcp_rmng", "Loc_extra", "Loc_tray", "Loc_extra_tray", "Loose_ssp_flag"]


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def with_axes(df: DataFrame, height: str, width: str, length: str) -> DataFrame:
    """Carton sides from shortest to longest, without building an array per row."""
    h, w, l = F.col(height), F.col(width), F.col(length)
    return df.withColumns(
        {
            "Ht": F.least(h, w, l),
            "Wt": F.greatest(F.least(h, w), F.least(F.greatest(h, w), l)),
            "Lt": F.greatest(h, w, l),
        }
    )


def with_geometry(df: DataFrame) -> DataFrame:
    """Slots one carton spans, and how many cartons one slot holds."""
    stackable = F.col("Ht") <= STACK_LIMIT
    layers = F.ceil(F.try_divide(F.lit(float(STACK_SPACE)), F.col("Ht")))
    sized = df.withColumns(
        {
            "Loc_wt": F.ceil(F.col("Wt") / F.lit(SLOT_WIDTH)),
            "Loc_lt": F.floor(F.try_divide(F.lit(SLOT_DEPTH), F.col("Lt"))),
            "Loc_ht1": F.when(stackable, FIRST_STACK).otherwise(0),
            "Loc_ht2": F.when(stackable, layers).otherwise(F.lit(0).cast("bigint")),
        }
    )
    stacked = F.col("Loc_ht1") + (F.col("Loc_lt") - 1) * F.col("Loc_ht2")
    return sized.withColumn(
        "Loc_tot", F.when(F.col("Loc_ht1") > 0, stacked).otherwise(F.col("Loc_lt"))
    )


def with_fit(df: DataFrame, vcp: str = "vcp", ssp: str = "ssp", ratio: str = "Ratio") -> DataFrame:
    """Locations for ``vcp`` full cartons plus a loose remainder of ``ratio`` cartons."""
    cartons = F.col(vcp) + flag(F.col(ratio) > LOOSE_BOX_RATIO)
    per_slot, width = F.col("Loc_tot"), F.col("Loc_wt")
    spare, slots = F.col("Loc_vcp_rmng"), F.col("Loc_extra")
    more = F.ceil(F.abs(F.try_divide(spare, per_slot)))
    no_more = F.lit(0).cast("bigint")
    loose_only = F.col("Loose_ssp_flag") == 1
    tray_slot = F.lit(1) - F.col("Loc_tray")
    return (
        df.withColumns(
            {
                "Loc_vcp_rmng": per_slot - cartons,
                "Loose_ssp_flag": flag((F.col(vcp) == 0) & (F.col(ssp) > 0)),
            }
        )
        .withColumn("Loc_extra", width + F.when(spare <= 0, width * more).otherwise(no_more))
        .withColumn("Loc_tray", flag((slots * per_slot - cartons) * F.col("Lt") > TRAY_SPACE))
        .withColumns(
            {
                "Loc_extra_tray": tray_slot,
                "Total_locs": F.when(loose_only, flag(F.col(ratio) > 0).cast("bigint")).otherwise(
                    slots + tray_slot
                ),
            }
        )
    )


def prepare(drops: DataFrame) -> DataFrame:
    """The short-named columns the estimate reads, next to the row's keys."""
    return drops.select(
        *[c for c in ("drop_id", "UnitSortable") if c in drops.columns],
        "Distro",
        "DPCI",
        "SSZ",
        F.col("TotalNumberofFullVCPs").alias("vcp"),
        F.col("TotalNumberofLooseSSP").alias("ssp"),
        F.col("TotalNumberofPallets").alias("pallet"),
        F.col("SSPsinVCP").alias("ssp_q"),
        "VCPHeight",
        "VCPWidth",
        "VCPLength",
        F.col("Aisle").alias("wh_aisle"),
    )


def estimate(
    df: DataFrame, height: str, width: str, length: str, vcp: str = "vcp", ssp: str = "ssp", ratio: str = "Ratio"
) -> DataFrame:
    """All location columns for a frame with cartons, loose pieces and their share of a pack."""
    return with_fit(with_geometry(with_axes(df, height, width, length)), vcp, ssp, ratio)


def distro_locations(drops: DataFrame) -> DataFrame:
    """Row grain: every intermediate value and ``Total_locs``; null when nothing fits."""
    rows = prepare(drops).withColumn("Ratio", F.try_divide(F.col("ssp"), F.col("ssp_q")))
    return estimate(rows, "VCPHeight", "VCPWidth", "VCPLength")


def with_distro_locs(drops: DataFrame, into: str = "Total_locs") -> DataFrame:
    """The whole input row plus its row-grain location count.

    The estimate is a function of the row alone, so no join is needed to attach it.
    """
    share = F.try_divide(F.col("TotalNumberofLooseSSP"), F.col("SSPsinVCP"))
    sized = estimate(
        drops.withColumn("_share", share),
        *("VCPHeight", "VCPWidth", "VCPLength"),
        vcp="TotalNumberofFullVCPs",
        ssp="TotalNumberofLooseSSP",
        ratio="_share",
    )
    return sized.select(*[F.col(c) for c in drops.columns], F.col("Total_locs").alias(into))
