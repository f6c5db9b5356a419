"""Table schemas and key columns shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A drop is planned one zone and one sortability flag at a time; planning all of
# them in one job means carrying these three columns as keys everywhere.
GROUP = ["drop_id", "UnitSortable", "SSZ"]
ITEM = [*GROUP, "DPCI"]

# Zone whose rows are always sized at item grain.
ITEM_GRAIN_ZONE = 2

QUANTITIES = [
    "TotalNumberofSSPsintheDistro",
    "SSPsinVCP",
    "TotalNumberofFullVCPs",
    "TotalNumberofLooseSSP",
    "TotalNumberofPallets",
]
DIMENSIONS = ["VCPHeight", "VCPWidth", "VCPLength"]

DROPS = T.StructType(
    [
        T.StructField("drop_id", T.StringType()),
        T.StructField("Distro", T.StringType()),
        T.StructField("DPCI", T.StringType()),
        T.StructField("SSZ", T.IntegerType()),
        T.StructField("UnitSortable", T.StringType()),
        T.StructField("AllocationRequestDate", T.TimestampNTZType()),
        T.StructField("Aisle", T.IntegerType()),
        *[T.StructField(name, T.LongType()) for name in QUANTITIES],
        *[T.StructField(name, T.DoubleType()) for name in DIMENSIONS],
    ]
)

AISLES = T.StructType(
    [
        T.StructField("UDC", T.IntegerType(), False),
        T.StructField("Aisle_No", T.IntegerType(), False),
        T.StructField("Pallet Locations", T.IntegerType(), False),
        T.StructField("Practically Usable Locations", T.IntegerType(), False),
        T.StructField("C+B locations", T.IntegerType(), False),
    ]
)

SCENARIOS = T.StructType(
    [
        T.StructField("scenario_id", T.IntegerType(), False),
        T.StructField("UDC", T.IntegerType(), False),
        T.StructField("Aisle_No", T.IntegerType(), False),
        T.StructField("Cap", T.DoubleType(), False),
        T.StructField("Method", T.StringType(), False),
        T.StructField("Level_A", T.BooleanType(), False),
    ]
)


def release_order() -> list[Column]:
    """Oldest request first, then nearby storage; the row key makes the order total."""
    return [
        F.col("AllocationRequestDate").asc_nulls_last(),
        F.col("Aisle").asc_nulls_last(),
        F.col("Distro").asc(),
        F.col("DPCI").asc(),
    ]
