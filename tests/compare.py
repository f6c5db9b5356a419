"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

DUCK_TYPES = {
    "integer": "INTEGER",
    "long": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else v) for v in row)


def same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """Raise AssertionError unless names, types and the multiset of rows agree."""
    names = sorted(df.columns)
    types = {f.name: DUCK_TYPES[f.dataType.typeName()] for f in df.schema}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert types == described, {k: (types.get(k), described.get(k)) for k in {*types, *described} if types.get(k) != described.get(k)}
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_sort_key)
    ours = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_sort_key)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs):
        if a != b:
            for x, y in zip(a, b):
                close = isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12)
                assert x == y or close, (dict(zip(names, a)), dict(zip(names, b)))
