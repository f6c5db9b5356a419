"""Hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from waveplan.schema import DROPS

START = datetime(2022, 7, 1)


def row(distro: str, **changes):
    values = {
        "drop_id": "a",
        "Distro": distro,
        "DPCI": f"item-{distro}",
        "SSZ": 1,
        "UnitSortable": "Y",
        "AllocationRequestDate": START,
        "Aisle": 1,
        "TotalNumberofSSPsintheDistro": 18,
        "SSPsinVCP": 6,
        "TotalNumberofFullVCPs": 3,
        "TotalNumberofLooseSSP": 0,
        "TotalNumberofPallets": 0,
        "VCPHeight": 10.0,
        "VCPWidth": 12.0,
        "VCPLength": 20.0,
    }
    values.update(changes)
    return tuple(values[name] for name in DROPS.fieldNames())


def sized_row(distro: str, locations: int, **changes):
    """A carton row that needs exactly ``locations`` (at least 2) at row grain.

    One carton per slot, so n cartons need 1 + (n - 1) slots and one more for the tray.
    """
    changes = {"VCPHeight": 10.0, "VCPWidth": 12.0, "VCPLength": 92.5, **changes}
    return row(distro, TotalNumberofFullVCPs=locations - 1, **changes)


def day(n: int) -> datetime:
    return START + timedelta(days=n)


def table(spark, rows):
    return spark.createDataFrame(rows, DROPS)
