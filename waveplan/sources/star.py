"""``drops`` derived from the order-line and part tables of a star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PACK = "(p_size % 12 + 1 + l_linenumber % 2)"

# Column name -> SQL expression; the same text is valid in Spark SQL and ANSI engines.
DROP_COLUMNS = {
    "drop_id": "CAST(year(l_shipdate) AS INT)",
    "Distro": (
        "concat(lpad(CAST(l_orderkey AS STRING), 8, '0'), '-', CAST(l_linenumber AS STRING), '-', "
        "lpad(CAST(l_partkey AS STRING), 6, '0'), '-', lpad(CAST(l_suppkey AS STRING), 5, '0'), '-', "
        "lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 9, '0'))"
    ),
    "DPCI": "lpad(CAST(l_partkey AS STRING), 6, '0')",
    "SSZ": "CAST(l_suppkey % 14 + 1 AS INT)",
    "UnitSortable": "CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END",
    "AllocationRequestDate": "l_shipdate",
    "Aisle": "CAST(l_partkey % 60 + 1 AS INT)",
    "TotalNumberofSSPsintheDistro": "CAST(l_quantity AS BIGINT)",
    "SSPsinVCP": f"CAST({_PACK} AS BIGINT)",
    "TotalNumberofFullVCPs": f"CAST(floor(l_quantity / {_PACK}) AS BIGINT)",
    "TotalNumberofLooseSSP": f"CAST(l_quantity AS BIGINT) % {_PACK}",
    "TotalNumberofPallets": (
        "CASE WHEN l_returnflag = 'R' AND l_quantity > 30 AND l_suppkey % 14 <> 3 "
        "THEN CAST(floor(l_quantity / 10) AS BIGINT) * (1 + l_suppkey % 14 % 3) - 2 "
        "ELSE CAST(0 AS BIGINT) END"
    ),
    "VCPHeight": "CAST(p_size AS DOUBLE) / 2 + CAST(l_linenumber % 2 AS DOUBLE) / 4",
    "VCPWidth": "CAST(4 + p_partkey % 23 AS DOUBLE)",
    "VCPLength": "CAST(6 + p_partkey % 97 AS DOUBLE)",
}

# A version with faults, derived by rule from the same rows: the key loses the parts
# that make it unique, and some sizes, quantities and keys are spoilt.
FAULTY_COLUMNS = {
    **DROP_COLUMNS,
    "Distro": "concat(lpad(CAST(l_orderkey AS STRING), 8, '0'), '-', CAST(l_linenumber AS STRING))",
    "DPCI": f"CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE {DROP_COLUMNS['DPCI']} END",
    "SSPsinVCP": f"CASE WHEN l_partkey % 53 = 0 THEN CAST(0 AS BIGINT) ELSE {DROP_COLUMNS['SSPsinVCP']} END",
    "TotalNumberofLooseSSP": (
        f"CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE {DROP_COLUMNS['TotalNumberofLooseSSP']} END"
    ),
    "VCPWidth": (
        "CASE WHEN l_linenumber = 5 AND p_size % 10 = 0 THEN CAST('NaN' AS DOUBLE) "
        f"WHEN p_size % 25 = 3 THEN NULL ELSE {DROP_COLUMNS['VCPWidth']} END"
    ),
}

# A version where some zones hold pallets only: one large zone, and many with a few rows.
STACKED_COLUMNS = {
    **DROP_COLUMNS,
    "SSZ": f"CASE WHEN l_suppkey % 14 = 5 THEN CAST(20 + l_orderkey % 400 AS INT) ELSE {DROP_COLUMNS['SSZ']} END",
    "TotalNumberofPallets": (
        f"CASE WHEN l_suppkey % 14 IN (5, 9) THEN CAST(l_quantity AS BIGINT) % 8 + 1 ELSE {DROP_COLUMNS['TotalNumberofPallets']} END"
    ),
}


def select_text(columns: dict[str, str] = DROP_COLUMNS) -> str:
    """The view as SQL text over ``lineitem`` and ``part``."""
    body = ",\n  ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT\n  {body}\nFROM lineitem JOIN part ON l_partkey = p_partkey"


def drops(spark: SparkSession, sf_dir: str, columns: dict[str, str] = DROP_COLUMNS) -> DataFrame:
    """One allocation row per order line; Distro is unique by construction.

    Parts grow with the lines; the engine broadcasts them only below its size limit.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
        *[f"{expr} AS {name}" for name, expr in columns.items()]
    )
