"""Branches of the plan on hand-made zones."""

import pytest
from rows import day, row, sized_row, table

from waveplan import Rules, Scenario, WavePlan, plan_waves
from waveplan.operators.cartons import last_waves

# 3840 / aisle 2: 854 carton locations, 8 pallet locations; cap 0.9 gives waves of 768.6.
PLAN = Scenario(3840, 2)


def waves(spark, rows, scenario=PLAN, **rules):
    plan = WavePlan(table(spark, rows), [scenario], rules=Rules(**rules))
    return {r.Distro: (r.wave_id, r.Total_locs) for r in plan.assigned.collect()}


def pallet(distro, pallets, **changes):
    return row(distro, TotalNumberofPallets=pallets, **changes)


def test_release_order_and_wave_cut(spark):
    rows = [
        sized_row("a", 700, AllocationRequestDate=day(2)),
        sized_row("b", 68, AllocationRequestDate=day(1), Aisle=9),
        sized_row("c", 700, AllocationRequestDate=day(1), Aisle=2),
        sized_row("d", 2, AllocationRequestDate=None),
        sized_row("e", 2, AllocationRequestDate=day(3), Aisle=None),
        sized_row("f", 2, AllocationRequestDate=day(3), Aisle=50),
    ]
    # c 700, b 768 (still below 768.6), a 1468 (wave 2), f 1470, e 1472, d 1474.
    found = waves(spark, rows)
    assert {k: v[0] for k, v in found.items()} == {
        "c": "W1", "b": "W1", "a": "W2", "f": "W2", "e": "W2", "d": "W2",
    }


def test_a_row_across_the_boundary_moves_on(spark):
    rows = [sized_row("a", 700), sized_row("b", 100), sized_row("c", 2000), sized_row("d", 5)]
    assert [v[0] for _, v in sorted(waves(spark, rows).items())] == ["W1", "W2", "W4", "W4"]


def test_leading_rows_of_size_zero_are_wave_zero(spark):
    rows = [
        row("a", DPCI="x", SSZ=2, AllocationRequestDate=day(0)),
        row("b", DPCI="x", SSZ=2, AllocationRequestDate=day(1)),
    ]
    # 6 cartons, 4 to a slot.
    assert waves(spark, rows) == {"a": ("W0", 0), "b": ("W1", 2)}


@pytest.mark.parametrize("method", ["Distro", "DPCI"])
def test_item_grain_is_forced_in_one_zone(spark, method):
    rows = [row(n, DPCI="x", SSZ=z) for n, z in (("a", 2), ("b", 2), ("c", 3))]
    # The item's highest Distro is in zone 3, so zone 2 is charged nothing.
    wanted = {"a": ("W0", 0), "b": ("W0", 0), "c": ("W1", 1)}
    assert waves(spark, rows, Scenario(3840, 2, method=method)) == wanted
    by_zone = {"a": ("W0", 0), "b": ("W1", 2), "c": ("W1", 1)}
    assert waves(spark, rows, Scenario(3840, 2, method=method), rank_scope="zone") == by_zone


def test_item_in_two_zones_is_charged_once_unless_ranked_by_zone(spark):
    rows = [row("a", DPCI="x", SSZ=5), row("b", DPCI="x", SSZ=7)]
    by_item = Scenario(3840, 2, method="DPCI")
    assert waves(spark, rows, by_item) == {"a": ("W0", 0), "b": ("W1", 1)}
    assert waves(spark, rows, by_item, rank_scope="zone") == {"a": ("W1", 1), "b": ("W1", 1)}


def test_rank_column(spark):
    rows = [row("a", DPCI="x"), row("b", DPCI="x"), row("c", DPCI="y"), pallet("d", 3)]
    plan = WavePlan(table(spark, rows), [Scenario(3840, 2, method="DPCI")], rules=Rules(with_rank=True))
    assert {r.Distro: r["rank"] for r in plan.assigned.collect()} == {"a": 2, "b": 1, "c": 1, "d": None}


def test_pallets_beside_carton_waves(spark):
    # Items by cartons: p 9 pallets (3 locations), q 15 (5), r 1 (1): cumulative 3, 8, 9.
    rows = [
        sized_row("a", 1000),
        pallet("p", 9, TotalNumberofFullVCPs=30),
        pallet("q", 15, TotalNumberofFullVCPs=20),
        pallet("r", 1, TotalNumberofFullVCPs=10),
    ]
    found = waves(spark, rows)
    assert found == {"a": ("W2", 1000), "p": ("W1", None), "q": ("W1", None), "r": ("W2", None)}


def test_pallet_items_with_equal_cartons_go_by_height_then_key(spark):
    rows = [
        sized_row("a", 10),
        pallet("p", 24, DPCI="1", VCPHeight=9.0, TotalNumberofFullVCPs=1),
        pallet("q", 24, DPCI="2", VCPHeight=11.0, TotalNumberofFullVCPs=1),
        pallet("r", 24, DPCI="0", VCPHeight=9.0, TotalNumberofFullVCPs=1),
    ]
    found = waves(spark, rows)
    assert (found["q"][0], found["r"][0], found["p"][0]) == ("W1", "W1", "W1")


@pytest.mark.parametrize(
    ("extra", "wave"), [(26, "W1"), (27, "Pallet_wave")], ids=["50 pallets", "51 pallets"]
)
def test_trailing_pallets_limit(spark, extra, wave):
    # 24 pallets fill the first pallet wave; the rest trails behind the only carton wave.
    rows = [
        sized_row("a", 10),
        pallet("p", 24, TotalNumberofFullVCPs=100),
        pallet("q", 24, TotalNumberofFullVCPs=50),
        pallet("r", extra, TotalNumberofFullVCPs=10),
    ]
    found = waves(spark, rows)
    assert found["p"] == ("W1", None)
    assert (found["q"][0], found["r"][0]) == (wave, wave)
    assert (found["q"][1] is None) == (wave == "Pallet_wave")


# 0.8 of 768.6 is 614.88.
@pytest.mark.parametrize(
    ("fill", "scenario", "wave"),
    [
        (614, PLAN, "W1"),
        (615, PLAN, "W_P1"),
        (10, Scenario(3841, 2), "W_P1"),
        (10, Scenario(3842, 2), "W_P1"),
    ],
)
def test_few_trailing_pallets(spark, fill, scenario, wave):
    rows = [
        sized_row("a", fill),
        pallet("p", 24, TotalNumberofFullVCPs=100),
        pallet("q", 20, TotalNumberofFullVCPs=50),
    ]
    found = waves(spark, rows, scenario)
    assert found["p"] == ("W1", None)
    # 50 cartons, 4 to a slot, with room for the tray in the last one.
    assert found["q"] == (wave, 13)


def test_fill_counts_the_last_wave_only(spark):
    rows = [
        sized_row("a", 768),
        sized_row("b", 400, AllocationRequestDate=day(1)),
        sized_row("c", 214, AllocationRequestDate=day(2)),
        pallet("p", 48, TotalNumberofFullVCPs=100),
        pallet("q", 20, TotalNumberofFullVCPs=50),
    ]
    assert waves(spark, rows)["q"][0] == "W2"
    rows[2] = sized_row("c", 215, AllocationRequestDate=day(2))
    assert waves(spark, rows)["q"][0] == "W_P1"


def test_zone_without_cartons(spark):
    few = [pallet("p", 24), pallet("q", 20, DPCI="z")]
    assert {v[0] for v in waves(spark, few).values()} == {"W_P1"}
    many = [pallet("p", 24), pallet("q", 27, DPCI="z")]
    assert {v[0] for v in waves(spark, many).values()} == {"Pallet_wave"}


def test_trailing_pallets_in_waves_by_storage_aisle(spark):
    rows = [
        sized_row("p", 500, TotalNumberofPallets=5, Aisle=3),
        sized_row("q", 500, TotalNumberofPallets=5, Aisle=1),
        sized_row("r", 500, TotalNumberofPallets=5, Aisle=2),
    ]
    found = waves(spark, rows)
    assert (found["q"], found["r"], found["p"]) == (("W_P1", 500), ("W_P2", 500), ("W_P2", 500))


def test_unknown_size_counts_as_one(spark):
    rows = [row("a", VCPLength=93.0), pallet("p", 24, SSZ=3, VCPLength=93.0)]
    assert waves(spark, rows) == {"a": ("W1", 1), "p": ("W_P1", 1)}


def test_zones_drops_and_flags_do_not_mix(spark):
    rows = [
        sized_row("a", 700, drop_id="1"),
        sized_row("b", 700, drop_id="2"),
        sized_row("c", 700, SSZ=3),
        sized_row("d", 700, UnitSortable="N"),
        sized_row("e", 700),
    ]
    assert {v[0] for v in waves(spark, rows).values()} == {"W1"}


def test_scenarios_share_a_plan(spark):
    rows = [sized_row("a", 700), sized_row("b", 700), pallet("p", 60), pallet("q", 20, SSZ=4)]
    scenarios = [PLAN, Scenario(3842, 2), Scenario(3840, 2, 1.0), Scenario(3840, 9, method="DPCI")]
    together = WavePlan(table(spark, rows), scenarios).assigned
    for i, scenario in enumerate(scenarios, start=1):
        alone = waves(spark, rows, scenario)
        mine = together.filter(together.scenario_id == i).collect()
        assert {r.Distro: (r.wave_id, r.Total_locs) for r in mine} == alone


def test_summary_of_a_zone(spark):
    rows = [
        sized_row("a", 10, TotalNumberofLooseSSP=1),
        pallet("p", 3, TotalNumberofFullVCPs=7, DPCI="item-a"),
    ]
    plan = plan_waves(table(spark, rows), PLAN)
    summary = plan.wave_summary.collect()
    assert len(summary) == 1
    got = summary[0].asDict()
    assert {k: got[k] for k in got if k.startswith("Total")} == {
        "Total_plts": 3,
        "Total_plts_ssps": 7,
        "Total_vcp": 16,
        "Total_loose_ssp": 1,
        "Total_ssp": 36,
        "Total_distro": 2,
        "Total_dpci": 1,
        "Total_CandB_locs": 10,
    }
    assert (got["Aisle_utilz"], got["Aisle_utilz_text"]) == (18 / 867, "2.08%")


def test_last_waves_agree_with_the_plan(spark, small):
    from waveplan.operators.summary import carton_ends
    from waveplan.sources.star import drops

    plan = WavePlan(drops(spark, small), [PLAN])
    limits = {(r.drop_id, r.UnitSortable, r.SSZ): (r.last_wave, r.last_fill) for r in last_waves(plan.carton_waves).collect()}
    for ends in (plan.ends, carton_ends(plan.carton_totals)):
        assert {(r.drop_id, r.UnitSortable, r.SSZ): (r.n_waves, r.last_wave_fill) for r in ends.collect()} == limits
    placed = plan.placed_pallets.collect()
    assert placed
    for r in placed:
        assert r.wave_no == limits[r.drop_id, r.UnitSortable, r.SSZ][0]
    plan.close()


def test_few_pallets_of_a_zone_without_cartons_beside_other_zones(spark):
    """One zone with cartons and room, one without: only the first has a wave to share."""
    rows = [sized_row("a", 10), pallet("p", 24, TotalNumberofFullVCPs=100), pallet("q", 20, TotalNumberofFullVCPs=50)]
    rows += [pallet("r", 24, SSZ=7, TotalNumberofFullVCPs=100), pallet("s", 20, SSZ=7, TotalNumberofFullVCPs=50)]
    found = waves(spark, rows)
    assert (found["q"][0], found["r"][0], found["s"][0]) == ("W1", "W_P1", "W_P1")


def test_an_item_in_cartons_and_on_pallets_is_counted_once(spark):
    rows = [sized_row("a", 10, DPCI="x"), sized_row("b", 10, DPCI="y"), sized_row("c", 10, DPCI="x")]
    rows += [pallet("p", 3, DPCI="x"), pallet("q", 3, DPCI="z")]
    for cell_rows in (1, 10**6):
        plan = WavePlan(table(spark, rows), [PLAN, Scenario(3840, 2, method="DPCI")], rules=Rules(cell_rows=cell_rows))
        # by item, rows without a charge before the first charged one are in wave 0
        counted = {(r.scenario_id, r.wave_id): r.Total_dpci for r in plan.wave_summary.collect()}
        assert counted == {(1, "W1"): 3, (2, "W1"): 3, (2, "W0"): 1}
        plan.close()
