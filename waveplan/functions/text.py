"""Column expressions for labels, and header clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label texts and the height in inches above which cartons go on top.
TOP_LEVEL_HEIGHT = 15
TOP_LEVEL = "Charge to Top Level"
LOWER_LEVELS = "Level A & B"


def charging_instructions(height: Column) -> Column:
    """Where to put a carton; an unknown height goes to the lower levels."""
    return F.when(height > TOP_LEVEL_HEIGHT, TOP_LEVEL).otherwise(LOWER_LEVELS)


def wave_label(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def clean_name(name: str) -> str:
    return name.replace(" ", "").replace("\n", "").replace("\r", "")


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without spaces and line breaks."""
    return df.toDF(*[clean_name(name) for name in df.columns])


def percent_text(share: Column) -> Column:
    """A non-negative share as a percentage with two decimals, ties to even.

    ``format_string`` rounds the shortest decimal form half up. Here the binary value
    is split exactly: its fraction times 2^60 is an integer, and the two decimals come
    from integer division with the remainder compared against one half.
    """
    percent = share * F.lit(100.0)
    whole = F.floor(percent)
    # A fraction below 2^-8 of a percent prints as zero, so lost low bits cannot matter.
    scaled = ((percent - whole) * F.lit(float(2**60))).cast("bigint").cast("decimal(20,0)") * F.lit(100)
    unit, half = F.lit(2**60).cast("decimal(20,0)"), F.lit(2**59).cast("decimal(20,0)")
    rest = scaled % unit
    down = ((scaled - rest) / unit).cast("bigint")
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    cents = whole * 100 + down + up.cast("bigint")
    return F.concat(
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
        F.lit("%"),
    )
