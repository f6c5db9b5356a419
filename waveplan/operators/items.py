"""Item grain: one size estimate per item and zone, charged to a single row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveplan.functions.locations import estimate
from waveplan.operators.filters import non_pallet
from waveplan.operators.running import CELL_ROWS, Order, running_sum, split
from waveplan.schema import GROUP, ITEM

# The item comes first: rows are sorted by these columns, and it tells most of them apart.
ITEM_FIRST = ["DPCI", *GROUP]
RANK_SCOPES = {"all_zones": ["DPCI", "drop_id", "UnitSortable"], "zone": ITEM_FIRST}


def item_rollup(drops: DataFrame) -> DataFrame:
    """Totals and largest carton of each item over its non-pallet rows."""
    return (
        non_pallet(drops)
        .groupBy(*ITEM)
        .agg(
            F.sum("TotalNumberofFullVCPs").alias("vcp1"),
            F.sum("TotalNumberofLooseSSP").alias("ssp"),
            F.sum("TotalNumberofPallets").alias("pallet"),
            F.max("SSPsinVCP").alias("ssp_q"),
            F.max("VCPHeight").alias("vend_cspk_ht_q"),
            F.max("VCPWidth").alias("vend_cspk_wth_q"),
            F.max("VCPLength").alias("vend_cspk_lgth_q"),
        )
    )


def size_items(rollup: DataFrame) -> DataFrame:
    """Whole packs of loose pieces count as cartons; the fraction stays loose."""
    packs = F.try_divide(F.col("ssp"), F.col("ssp_q"))
    sized = rollup.withColumns(
        {"vcp": F.col("vcp1") + F.floor(packs), "Ratio": packs - F.floor(packs)}
    )
    return estimate(sized, "vend_cspk_ht_q", "vend_cspk_wth_q", "vend_cspk_lgth_q")


def item_locations(drops: DataFrame) -> DataFrame:
    return size_items(item_rollup(drops))


def join_item_locations(drops: DataFrame) -> DataFrame:
    """Every non-pallet row with the locations of its whole item."""
    sizes = item_locations(drops).select(*ITEM, "Total_locs")
    return non_pallet(drops).join(sizes, ITEM, "left")


MARK = "_mark"
RANK = Order(None, None, "Distro", ("SSZ",), descending=("Distro",))


def with_item_rank(
    drops: DataFrame, rank_scope: str = "all_zones", cell_rows: int = CELL_ROWS, paths: list[str] | None = None, total: int | None = None
) -> DataFrame:
    """Non-pallet rows with their position in the item, highest Distro first; equal ones go by zone.

    A position is a running count, so a hot item is cut like any large group.
    """
    one = non_pallet(drops).withColumn("_one", F.lit(1).cast("bigint"))
    scope = RANK_SCOPES[rank_scope]
    parts = split(one, scope, RANK, cell_rows, paths, total)
    return running_sum(one, scope, RANK, "_one", "rank", parts=parts).drop("_one")


def first_distro_masked(drops: DataFrame, rank_scope: str = "all_zones", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Item locations and rank on every non-pallet row, with locations kept on rank 1 only."""
    ranked = with_item_rank(join_item_locations(drops), rank_scope, cell_rows)
    return ranked.withColumn(
        "Total_locs", F.when(F.col("rank") > 1, F.lit(0)).otherwise(F.col("Total_locs")).cast("bigint")
    )


def item_charges(drops: DataFrame, rank_scope: str = "all_zones", zone: int | None = None) -> DataFrame:
    """The one row of each item that its locations are charged to: its key, where it stands in release order,
    and ``_charge``. It is the row of rank 1, with the highest Distro; equal ones go to the lower zone.

    Rows are aggregated before they move, so a hot item travels as one row a task. A maximum of texts makes
    Spark sort its input, so that is done on few columns, apart from the sizes. ``zone`` keeps what is charged in one zone.
    """
    rows, scope = non_pallet(drops), RANK_SCOPES[rank_scope]
    sized = rows
    if zone is not None:
        sized = rows.filter(F.col("SSZ") == zone)
        rows = sized if rank_scope == "zone" else rows
    row = F.struct("Distro", (-F.col("SSZ")).alias("low"), "AllocationRequestDate", "Aisle")
    first = rows.groupBy(*scope).agg(F.max(row).alias("_top"))
    own = {"SSZ": -F.col("_top.low")} if rank_scope == "all_zones" else {}
    first = first.withColumns(own | {c: F.col(f"_top.{c}") for c in ("Distro", "AllocationRequestDate", "Aisle")}).drop("_top")
    if zone is not None:
        first = first.filter(F.col("SSZ") == zone)
    # an item of a zone is one row on either side, so no part of the hash table is larger than others;
    # only what is charged is sized
    sizes = size_items(first.hint("shuffle_hash").join(item_rollup(sized), ITEM_FIRST))
    return sizes.select(*first.columns, F.col("Total_locs").alias("_charge"))


def with_charges(rows: DataFrame, charges: DataFrame, place: list[str]) -> DataFrame:
    """Rows and, directly before its row in any order that ends with ``MARK``, each charge.

    A charge is one row an item, so it moves beside the rows instead of being joined with all rows of
    the item. Both are dealt by ``place``, if it is given, and the union keeps that.
    """
    marked = rows.withColumns({"_charge": F.lit(None).cast("bigint"), MARK: F.lit(1)})
    charges = charges.withColumn(MARK, F.lit(0))
    if place:
        marked, charges = marked.repartition(*place), charges.repartition(*place)
    return marked.unionByName(charges, allowMissingColumns=True)
