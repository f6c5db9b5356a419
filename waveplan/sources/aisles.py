"""The sorting-aisle dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveplan.schema import AISLES
from waveplan.session import local_table

# Centre, aisle, locations for pallets, usable locations, locations for
# cartons and bins.
AISLE_ROWS = [
    (3840, 1, 54, 54, 0),
    (3840, 2, 8, 862, 854),
    (3840, 3, 8, 880, 872),
    (3840, 4, 8, 862, 854),
    (3840, 5, 8, 878, 870),
    (3840, 6, 8, 864, 856),
    (3840, 7, 8, 920, 912),
    (3840, 8, 8, 862, 854),
    (3840, 9, 8, 796, 788),
    (3840, 10, 8, 812, 804),
    (3840, 11, 8, 876, 868),
    (3840, 12, 8, 888, 880),
    (3840, 13, 8, 618, 610),
    (3840, 14, 99, 99, 0),
    (3842, 1, 58, 58, 0),
    (3842, 2, 8, 500, 492),
    (3842, 3, 8, 509, 501),
    (3842, 4, 8, 500, 492),
    (3842, 5, 8, 509, 501),
    (3842, 6, 8, 500, 492),
    (3842, 7, 8, 509, 501),
    (3842, 8, 8, 446, 438),
    (3842, 9, 8, 500, 492),
    (3842, 10, 8, 500, 492),
    (3842, 11, 8, 386, 378),
    (3842, 12, 8, 386, 378),
    (3842, 13, 8, 386, 378),
    (3842, 14, 8, 386, 378),
    (3842, 15, 8, 386, 378),
    (3842, 16, 56, 56, 0),
    (3841, 2, 8, 778, 770),
    (3841, 3, 8, 778, 770),
    (3841, 4, 8, 778, 770),
    (3841, 5, 8, 778, 770),
    (3841, 6, 8, 778, 770),
    (3841, 7, 8, 778, 770),
    (3841, 8, 8, 778, 770),
    (3841, 9, 8, 778, 770),
    (3841, 10, 8, 778, 770),
    (3841, 11, 8, 778, 770),
    (3841, 12, 8, 778, 770),
    (3841, 13, 8, 778, 770),
    (3841, 14, 46, 46, 0),
]


def aisle_rows() -> list[tuple[int, int, int, int, int]]:
    return list(AISLE_ROWS)


def aisles(spark: SparkSession) -> DataFrame:
    return local_table(spark, AISLE_ROWS, AISLES)
