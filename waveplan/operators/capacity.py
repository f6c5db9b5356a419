"""Aisle capacities for a list of planning scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveplan.schema import SCENARIOS
from waveplan.session import local_table
from waveplan.sources.aisles import aisles as aisle_table

# Extra locations opened by level A, and the aisles that have it.
LEVEL_A_CENTRE = 3842
LEVEL_A_NEAR = (2, 10, 163)
LEVEL_A_FAR = (11, 14, 127)

METHODS = ("Distro", "DPCI")
#: Scenarios that stand beside each other in one row, at most.
BESIDE = 16


@dataclass(frozen=True)
class Scenario:
    """One set of planning choices; zone, drop and sortability are keys of the data."""

    udc: int
    aisle: int
    cap: float = 0.9
    method: str = "Distro"
    level_a: bool = False

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if not 0 < self.cap < float("inf"):
            raise ValueError("cap must be above 0")


def scenario_table(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    rows = [
        (i, s.udc, s.aisle, float(s.cap), s.method, s.level_a) for i, s in enumerate(scenarios, start=1)
    ]
    return local_table(spark, rows, SCENARIOS)


def _lookup(spark: SparkSession, scenarios: list[Scenario], aisles: DataFrame | None) -> DataFrame:
    """Scenarios with their aisle; ``copies`` counts the aisle's rows, of which one is taken."""
    dim = aisle_table(spark) if aisles is None else aisles
    values = [F.max(c).alias(c) for c in ("Pallet Locations", "Practically Usable Locations", "C+B locations")]
    dim = dim.groupBy("UDC", "Aisle_No").agg(*values, F.count(F.lit(1)).alias("copies"))
    return scenario_table(spark, scenarios).join(dim, ["UDC", "Aisle_No"], "left")


def _fault() -> Column:
    """Why a scenario cannot be planned, else null."""
    return (
        F.when(F.col("copies").isNull(), "unknown_aisle")
        .when(F.col("copies") > 1, "repeated_aisle")
        .when(F.coalesce("C+B locations", F.lit(0)) <= 0, "no_carton_capacity")
        .when(F.coalesce("Pallet Locations", F.lit(0)) <= 0, "no_pallet_locations")
    )


def capacities(
    spark: SparkSession,
    scenarios: list[Scenario],
    aisles: DataFrame | None = None,
    fix_level_a: bool = False,
) -> DataFrame:
    """Wave sizes per scenario; scenarios that cannot be planned are left out.

    Level A enlarges carton waves in one centre only, but the practical locations of
    its near aisles in every centre, and never those of the far aisles.
    ``fix_level_a`` applies one rule to both.
    """
    aisle = F.col("Aisle_No")
    near = F.col("Level_A") & aisle.between(*LEVEL_A_NEAR[:2])
    far = F.col("Level_A") & aisle.between(*LEVEL_A_FAR[:2])
    centre = F.col("UDC") == LEVEL_A_CENTRE
    uplift = F.when(centre & near, LEVEL_A_NEAR[2]).when(centre & far, LEVEL_A_FAR[2]).otherwise(0)
    practical_uplift = uplift if fix_level_a else F.when(near, LEVEL_A_NEAR[2]).otherwise(0)
    return (
        _lookup(spark, scenarios, aisles)
        .filter(_fault().isNull())
        .select(
            *SCENARIOS.fieldNames(),
            F.col("Pallet Locations").alias("pallet_size"),
            (F.col("C+B locations") + uplift).alias("carton_locations"),
            (F.col("Cap") * (F.col("C+B locations") + uplift)).alias("carton_size"),
            (F.col("Practically Usable Locations") + practical_uplift).alias("practical_locations"),
        )
    )


def numbered(capacity: DataFrame, beside: int, keys: list[str] | None = None) -> DataFrame:
    """Scenarios (of each of ``keys``) with ``_lot`` and ``_slot``: of a lot, at most ``beside``, each has a slot of its own."""
    if not keys:
        # the scenarios' own numbers, from 1 on; one that cannot be planned leaves its slot empty
        place, every, columns = F.col("scenario_id") - 1, capacity, capacity.columns
    else:
        rest = [c for c in capacity.columns if c not in ("scenario_id", *keys)]
        listed = F.array_sort(F.collect_list(F.struct("scenario_id", *rest))).alias("_all")
        every = capacity.groupBy(*keys).agg(listed).select(*keys, F.posexplode("_all").alias("_place", "_one"))
        place, columns = F.col("_place"), [*keys, "_one.*"]
    lot, slot = F.floor(place / beside).cast("int"), place % beside
    return every.select(lot.alias("_lot"), slot.alias("_slot"), *columns)


def lots(scenarios: DataFrame, beside: int, columns: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """One row a lot of :func:`numbered` scenarios, with what stands in each slot: ``columns`` (prefix to column) + the slot."""
    own = [F.max(F.when(F.col("_slot") == j, F.col(c))).alias(f"{prefix}{j}") for j in range(beside) for prefix, c in columns.items()]
    return scenarios.groupBy(*(keys or []), "_lot").agg(*own)


def rejected_scenarios(
    spark: SparkSession, scenarios: list[Scenario], aisles: DataFrame | None = None
) -> DataFrame:
    return (
        _lookup(spark, scenarios, aisles)
        .withColumn("reject_reason", _fault())
        .filter(F.col("reject_reason").isNotNull())
        .select(*SCENARIOS.fieldNames(), "reject_reason")
    )
