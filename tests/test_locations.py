"""Location rules on hand-made cartons."""

import pytest
from rows import row, table

from waveplan.functions.locations import distro_locations, with_distro_locs
from waveplan.functions.text import charging_instructions, percent_text

# vcp, ssp, pack, (H, W, L) -> Loc_wt, Loc_lt, Loc_ht2, Loc_tot, rmng, extra, tray, Total_locs
CASES = [
    (3, 0, 6, (10, 12, 20), (1, 4, 0, 4, 1, 1, 1, 1)),
    (0, 4, 6, (10, 12, 20), (1, 4, 0, 4, 3, "-", "-", 1)),
    (8, 2, 6, (5, 12, 20), (1, 4, 2, 8, 0, 1, 0, 2)),
    (8, 2, 6, (5.5, 12, 20), (1, 4, 0, 4, -4, 2, 0, 3)),
    (4, 0, 6, (10, 12, 20), (1, 4, 0, 4, 0, 1, 0, 2)),
    (3, 3, 6, (10, 12, 20), (1, 4, 0, 4, 1, 1, 1, 1)),
    (3, 4, 6, (10, 12, 20), (1, 4, 0, 4, 0, 1, 0, 2)),
    (2, 0, 6, (10, 16, 20), (2, 4, 0, 4, 2, 2, 1, 2)),
    (2, 0, 6, (10, 31, 40), (2, 2, 0, 2, 0, 2, 1, 2)),
    (5, 0, 6, (10, 12, 92.5), (1, 1, 0, 1, -4, 5, 0, 6)),
    (5, 0, 6, (10, 12, 93), (1, 0, 0, 0, -5, None, 0, None)),
    (5, 0, 6, (2, 12, 100), (1, 0, 5, -3, -8, 4, 0, 5)),
    (5, 0, 6, (5, 12, 100), (1, 0, 2, 0, -5, None, 0, None)),
    (11, 0, 6, (2.5, 15.5, 30), (1, 3, 4, 10, -1, 2, 1, 2)),
    (0, 0, 6, (10, 12, 20), (1, 4, 0, 4, 4, 1, 1, 1)),
    (1, 0, 6, (8, 8, 92.5), (1, 1, 0, 1, 0, 1, 0, 2)),
    (0, 0, 6, (10, 12, 93), (1, 0, 0, 0, 0, None, 0, None)),
]
COLUMNS = ["Loc_wt", "Loc_lt", "Loc_ht2", "Loc_tot", "Loc_vcp_rmng", "Loc_extra", "Loc_tray", "Total_locs"]


@pytest.mark.parametrize("turn", [(0, 1, 2), (1, 2, 0), (2, 1, 0), (2, 0, 1)])
def test_truth_table(spark, turn):
    rows = [
        row(
            str(i),
            TotalNumberofFullVCPs=vcp,
            TotalNumberofLooseSSP=ssp,
            SSPsinVCP=pack,
            VCPHeight=float(sides[turn[0]]),
            VCPWidth=float(sides[turn[1]]),
            VCPLength=float(sides[turn[2]]),
        )
        for i, (vcp, ssp, pack, sides, _) in enumerate(CASES)
    ]
    found = {r.Distro: r for r in distro_locations(table(spark, rows)).collect()}
    for i, case in enumerate(CASES):
        for name, wanted in zip(COLUMNS, case[-1]):
            assert wanted == "-" or found[str(i)][name] == wanted, (i, name)


def test_more_loose_than_a_pack_counts_once(spark):
    """At row grain loose pieces are never turned into cartons."""
    found = distro_locations(table(spark, [row("1", TotalNumberofLooseSSP=20)])).first()
    assert (found.Loc_vcp_rmng, found.Total_locs) == (0, 2)


def test_division_by_zero_is_unknown_not_an_error(spark):
    rows = [row("1", VCPLength=0.0), row("2", SSPsinVCP=0)]
    found = {r.Distro: r for r in distro_locations(table(spark, rows)).collect()}
    assert (found["1"].Loc_tot, found["2"].Ratio, found["2"].Total_locs) == (None, None, 1)


def test_extra_columns_stay(spark):
    df = table(spark, [row("1")]).selectExpr("*", "'x' AS note")
    assert with_distro_locs(df).columns == [*df.columns, "Total_locs"]


def test_charging_instructions(spark):
    df = spark.createDataFrame([(15.0,), (15.25,), (None,)], "h double")
    labels = [r[0] for r in df.select(charging_instructions(df.h)).collect()]
    assert labels == ["Level A & B", "Charge to Top Level", "Level A & B"]


def test_percent_text_rounds_the_binary_value(spark):
    shares = [0.10125, 0.10375, 0.0, 1e-5, 4.9e-5, 5.1e-5, 0.99995, 1.0, 1.005, 12.345678, 0.02675, 0.1, 1 / 3, 250.0]
    shares += [i / 867 for i in range(0, 2000, 7)] + [i / 8000 for i in range(2000)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = {r[0]: r[1] for r in df.select("s", percent_text(df.s)).collect()}
    assert got == {s: f"{s:.2%}" for s in shares}
