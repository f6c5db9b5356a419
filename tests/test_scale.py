"""Hot groups, plan shapes and invariants."""

import json
import re
import subprocess
import sys
from pathlib import Path

import pytest
from rows import table
from pyspark.sql import Window
from pyspark.sql import functions as F

from waveplan import Rules, Scenario, WavePlan
from waveplan.operators import cartons, items, summary
from waveplan.operators.running import Order, running_sum, split
from waveplan.plans.catalog import QUERIES, SCENARIOS
from waveplan.plans.scenarios import scenario_sweep
from waveplan.schema import GROUP, release_order
from waveplan.session import _WRITTEN, release, shared_folder, size_shuffles
from waveplan.sources.star import drops

PLAN = Scenario(3840, 2)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def text_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fine_cells_give_the_same_plan(spark, small):
    source = drops(spark, small)
    scenarios = [PLAN, Scenario(3842, 2), Scenario(3842, 12, 1.0, "DPCI")]
    usual = WavePlan(source, scenarios)
    fine = WavePlan(source, scenarios, rules=Rules(cell_rows=1))
    assert rows_of(fine.assigned) == rows_of(usual.assigned)
    assert rows_of(fine.pallet_waves) == rows_of(usual.pallet_waves)


def test_one_zone_with_one_release_date(spark, small):
    """All rows in one zone with one date and aisle: only the row key orders them."""
    source = drops(spark, small).withColumns(
        {
            "drop_id": F.lit(1),
            "UnitSortable": F.lit("Y"),
            "SSZ": F.lit(3),
            "Aisle": F.lit(1),
            "AllocationRequestDate": F.lit("2022-07-01").cast("timestamp_ntz"),
        }
    )
    usual, fine = (WavePlan(source, [PLAN], rules=Rules(cell_rows=n)) for n in (10**6, 100))
    assert rows_of(fine.assigned) == rows_of(usual.assigned)
    assert rows_of(scenario_sweep(source, SCENARIOS, cell_rows=100)) == rows_of(scenario_sweep(source, SCENARIOS))


def tasks(spark, rows, total) -> list[int]:
    """Rows by task that computes ``total``, without merging of small partitions."""
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    counts = [r["count"] for r in rows.filter(F.col(total) >= 0).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset(merging)
    return counts


def test_a_hot_zone_is_spread_over_tasks(spark, small):
    """One date and aisle: rows are dealt by parts of the key, about as many rows in each."""
    source = drops(spark, small).withColumns(
        {"drop_id": F.lit(1), "UnitSortable": F.lit("Y"), "SSZ": F.lit(3), "Aisle": F.lit(1), "AllocationRequestDate": F.lit("2022-07-01").cast("timestamp_ntz")}
    )
    counts = tasks(spark, cartons.running_cartons(source, ["Distro"], cell_rows=200), "wave_cum_locations")
    assert len(counts) > 1 and max(counts) <= 400


def test_an_outlier_among_uneven_keys_does_not_fill_a_part(spark):
    """Keys that share all but the last characters, and one that shares nothing with them."""
    keys = [f"aaaaaaaaaa-{'7' * (i % 3)}{i % 7}{i:06d}" for i in range(20_000)] + ["zz"]
    rows = spark.createDataFrame([(1, 1, k, 1) for k in keys], "g int, d int, k string, v long")
    order = Order("d", None, "k")
    parts = split(rows, ["g"], order, 200)
    sizes = [r["count"] for r in parts.label(rows).groupBy(*parts.place).count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == len(keys)
    assert max(tasks(spark, running_sum(rows, ["g"], order, "v", "s", parts=parts), "s")) <= 600
    got = sorted((r.k, r.s) for r in running_sum(rows, ["g"], order, "v", "s", parts=parts).collect())
    assert [s for _, s in got] == list(range(1, len(keys) + 1))


def test_rows_that_cannot_be_told_apart_stay_in_one_part(spark):
    rows = spark.createDataFrame([(1, 1, "same", i) for i in range(300)] + [(1, None, None, 7)] * 3, "g int, d int, k string, v long")
    got = running_sum(rows, ["g"], Order("d", None, "k", ("v",)), "v", "s", 50).orderBy("s").collect()
    assert [r.s for r in got][-1] == sum(range(300)) + 21 and len(got) == 303


def test_refined_nodes_are_bounded(spark, monkeypatch):
    from waveplan.operators import running

    monkeypatch.setattr(running, "MOST_NODES", 10)
    rows = spark.range(3000).selectExpr("id % 3 AS g", "id % 11 AS d", "CAST(id AS STRING) AS k", "id AS v")
    parts = split(rows, ["g"], Order("d", None, "k"), 1)
    assert all(level.count() <= 10 for level in parts.levels)


def test_hot_item_rank(spark, small):
    source = drops(spark, small).withColumn("DPCI", F.when(F.col("SSZ") % 3 == 0, "hot").otherwise(F.col("DPCI")))
    usual = items.with_item_rank(source)
    assert rows_of(items.with_item_rank(source, cell_rows=50)) == rows_of(usual)
    assert usual.filter("DPCI = 'hot'").count() > 500


@pytest.mark.parametrize("descending", [(), ("k",), ("d", "k"), ("d", "a", "k")])
def test_running_sums_equal_a_window(spark, descending):
    import random

    make = random.Random(1)
    rows = [
        (make.choice(["a", "b", None, "hot", "hot"]), make.choice([1, 2, 3, None, 7, 7]), make.choice([1, 2, None]), f"é{make.randrange(3000):08d}", i, make.randrange(5))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "g string, d int, a int, k string, t long, v long")
    order = Order("d", "a", "k", ("t",), descending)
    whole = Window.partitionBy("g")
    upto = whole.orderBy(*order.columns()).rowsBetween(Window.unboundedPreceding, 0)
    expected = rows_of(df.withColumn("s", F.sum("v").over(upto)).withColumn("all", F.sum("v").over(whole)))
    for cell_rows in (10, 100, 10**6):
        assert rows_of(running_sum(df, ["g"], order, "v", "s", cell_rows, total="all")) == expected


def test_written_tables_go(spark, small, tmp_path):
    source = drops(spark, small)
    plan, other = WavePlan(source, [PLAN]), WavePlan(source, [PLAN])
    plan.wave_summary.collect(), other.pallet_running.count()
    paths = list(plan.written)
    assert len(paths) == 2 and all(Path(p.removeprefix("file:")).exists() for p in paths)
    plan.close()
    assert not any(Path(p.removeprefix("file:")).exists() for p in paths)
    assert other.pallet_running.count() > 0
    release(spark)
    assert _WRITTEN == [] and not list(Path(shared_folder(spark)).glob("waveplan/*"))


def test_rows_are_shuffled_once_for_their_order(spark, small):
    """One exchange takes rows to their place in the zone; sums and totals are made there."""
    plan = WavePlan(drops(spark, small), [PLAN], rules=Rules(rank_scope="zone"))
    released = cartons.release_rows(plan.drops, plan.charges, plan._release_parts)
    ran = cartons.carton_running(released, ["Distro"], plan._release_parts, bounds=True).withColumn("on_pallets", F.lit(False))
    waved = cartons.carton_waves(cartons.by_method(ran, ["Distro"]), plan.capacity)
    shuffles = lambda df: text_plan(df).count("Exchange hashpartitioning")
    beside = shuffles(items.item_charges(plan.drops, "zone", 2)) + shuffles(plan.capacity)
    # the rows, and beside them one row an item
    assert shuffles(waved) == beside + 2 == shuffles(summary.carton_totals(waved))


SHUFFLED = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from waveplan import Scenario, WavePlan, plan_waves
from waveplan.plans.catalog import SCENARIOS
from waveplan.session import build_session
spark = build_session("local[4]", 4, **{{"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false", "spark.eventLog.dir": {log!r}, "spark.checkpoint.dir": {shared!r}}})
source = spark.read.parquet({drops!r})
{body}
spark.stop()
"""


def event_log(tmp_path, source, body) -> tuple[int, int]:
    """Rows shuffled and rows read from ``source`` by a script, from Spark's event log."""
    log = tmp_path / "log"
    log.mkdir()
    script = SHUFFLED.format(root=str(Path(__file__).resolve().parents[1]), log=str(log), shared=str(tmp_path / "shared"), drops=str(source), body=body)
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=300)
    shuffled, read = 0, {}
    (file,) = [f for f in log.rglob("*") if f.is_file() and "appstatus" not in f.name and not f.name.endswith(".crc")]
    scans = {}

    def nodes(info):
        if info["nodeName"].startswith("Scan parquet") and f"{source}" in json.dumps(info.get("metadata", {})):
            for metric in info["metrics"]:
                if metric["name"] == "number of output rows":
                    scans[metric["accumulatorId"]] = 0
        for child in info["children"]:
            nodes(child)

    for line in file.open():
        event = json.loads(line)
        if "sparkPlanInfo" in event:
            nodes(event["sparkPlanInfo"])
        if event["Event"] == "SparkListenerTaskEnd":
            shuffled += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Records Written"]
            for update in event["Task Info"]["Accumulables"]:
                read[update["ID"]] = read.get(update["ID"], 0) + int(update["Update"]) if str(update.get("Update", "")).isdigit() else read.get(update["ID"], 0)
    return shuffled, sum(read.get(k, 0) for k in scans)


@pytest.fixture(scope="module")
def stored(spark, medium, tmp_path_factory):
    path = tmp_path_factory.mktemp("stored") / "drops"
    drops(spark, medium).write.parquet(str(path))
    return path, spark.read.parquet(str(path)).count()


def test_a_summary_moves_each_row_about_twice(stored, tmp_path):
    """Once to its item, to find what is charged, and once to its place in the zone."""
    path, rows = stored
    shuffled, _ = event_log(tmp_path, path, "WavePlan(source, [Scenario(3840, 2)]).wave_summary.collect()")
    assert shuffled <= 2.4 * rows


def test_scenarios_of_a_method_do_not_multiply_what_moves(stored, tmp_path):
    path, _ = stored
    chosen = "[Scenario(3842, a, c) for a, c in [(2, 0.9), (3, 0.9), (4, 0.9), (5, 0.8), (6, 0.9), (7, 1.0), (8, 0.9)]]"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    one, _ = event_log(tmp_path / "a", path, "s = [Scenario(3842, 2)]; p = WavePlan(source, s); p.carton_totals.count()")
    seven, _ = event_log(tmp_path / "b", path, f"s = {chosen}; p = WavePlan(source, s); p.carton_totals.count()")
    assert seven <= 1.1 * one


def test_scenarios_of_a_method_do_not_multiply_the_pallets_that_move(stored, tmp_path):
    path, _ = stored
    chosen = "[Scenario(3842, a, c) for a, c in [(2, 0.9), (3, 0.9), (4, 0.9), (5, 0.8), (6, 0.9), (7, 1.0), (8, 0.9)]]"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    body = "p = WavePlan(source, {}); p.placed_pallets.groupBy().agg(F.count('placement'), F.sum('trailing_locations')).collect()"
    one, _ = event_log(tmp_path / "a", path, body.format("[Scenario(3842, 2)]"))
    seven, _ = event_log(tmp_path / "b", path, body.format(chosen))
    assert seven <= 1.1 * one


def test_large_parts_are_found_by_the_first_value(spark, monkeypatch):
    from waveplan.operators import running

    rows = spark.range(3000).selectExpr("id % 2 AS g", "id % 3 AS d", "id % 50 AS a", "concat('k', id) AS k", "1L AS v")
    order, written = Order("d", "a", "k"), []
    keep = running.materialize
    monkeypatch.setattr(running, "materialize", lambda df, name, paths=None: written.append((name, df.columns)) or keep(df, name, paths))
    few = split(rows, ["g"], order, 600)
    assert written[0] == ("cells", ["g", "d", "_rows"]) and len(few.levels) == 1
    parts = split(rows, ["g"], order, 300)
    assert [n.count() for n in parts.levels] == [2, 6]
    monkeypatch.setattr(running, "MANY_PARTS", 1)
    fine = split(rows, ["g"], order, 300)
    assert written[-1][0] == "nodes" and ("cells", ["g", "d", "a", "_rows"]) in written
    assert [n.count() for n in fine.levels] == [2, 6]
    for tree in (parts, fine):
        got = {r.k: r.s for r in running_sum(rows, ["g"], order, "v", "s", parts=tree).collect()}
        place = {}
        for g in range(2):
            own = sorted((i % 3, i % 50, f"k{i}") for i in range(3000) if i % 2 == g)
            place |= {k: n for n, (_, _, k) in enumerate(own, 1)}
        assert got == place


@pytest.mark.parametrize("cell_rows", [10**6, 40])
def test_items_of_a_wave_are_counted_once(spark, small, cell_rows):
    """Also where rows of size zero stand between those of an item, and items have no name."""
    source = drops(spark, small).withColumn("DPCI", F.when(F.col("Aisle") == 7, None).otherwise(F.concat(F.lit("i"), F.col("Aisle") % 9)))
    plan = WavePlan(source, SCENARIOS[:3], rules=Rules(cell_rows=cell_rows))
    totals = plan.carton_totals
    new = F.when(F.col("_item").isNull(), F.col("_items")).otherwise(F.lit(1))
    wave = [*summary.WAVE, "wave_no"]
    got = {tuple(r) for r in totals.groupBy(*wave, "_item").agg(F.sum("_items").alias("_items")).groupBy(*wave).agg(F.sum(new)).collect()}
    rows = plan.carton_waves.groupBy(*wave).agg(F.countDistinct("DPCI"))
    assert got == {tuple(r) for r in rows.collect()}


def test_rows_alone_in_their_wave_move_as_one_row_a_wave(spark, small):
    """Items are counted before rows meet scenarios: no aggregate there has a row an item, but for items on pallets."""
    plan = WavePlan(drops(spark, small), SCENARIOS[:2])
    before = summary.with_item_before(plan.running.withColumn("on_pallets", F.lit(False)))
    totals = summary.carton_totals(cartons.carton_waves(before, plan.capacity))
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\][^\n]*_items|HashAggregate\(keys=\[([^\]]*wave_no[^\]]*)\]", text_plan(totals))
    assert keys and not any("DPCI" in k.split("CASE")[0] for pair in keys for k in pair)
    assert totals.count() == plan.carton_waves.select(*summary.WAVE, "wave_no").distinct().count()


def test_raw_input_is_read_twice_and_split_without_loss(stored, tmp_path):
    path, rows = stored
    body = (
        "raw = source.withColumn('SSPsinVCP', F.when(F.col('DPCI').endswith('7'), 0).otherwise(F.col('SSPsinVCP')))\n"
        "p = plan_waves(raw, Scenario(3840, 2)); n = p.assigned.count(); m = p.rejects.count(); p.wave_summary.collect()\n"
        "assert n + m == p.counts['rows'] and m == p.counts['rejects'] > 0, (n, m, p.counts)\n"
    )
    _, read = event_log(tmp_path, path, body)
    assert rows <= read <= 2 * rows


def test_headers_cost_a_block_of_each_file(spark, tmp_path, monkeypatch):
    from waveplan.sources import csv

    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("a,b\n" + "1,2\n" * 300_000)
    asked = []
    monkeypatch.setattr(csv, "record_end", lambda data, multi_line, end=csv.record_end: asked.append(len(data)) or end(data, multi_line))
    assert list(map(len, csv.file_headers(spark, str(tmp_path), False).values())) == [3]
    assert asked == [csv.BLOCK] * 3


def test_export_writes_nothing_but_its_output(spark, small, tmp_path):
    plan = WavePlan(drops(spark, small), [PLAN])
    plan.assigned.write.parquet(str(tmp_path / "out"))
    assert [Path(p).name.split("-")[0] for p in plan.written] == ["pallets"]  # a row per pallet item
    plan.close()


def test_every_row_is_placed_once_per_scenario(spark, small):
    source = drops(spark, small)
    plan = WavePlan(source, SCENARIOS).assigned
    per_key = plan.groupBy("Distro", "scenario_id").count()
    assert per_key.count() == source.count() * len(SCENARIOS)
    assert per_key.filter("count <> 1").isEmpty()
    assert plan.filter("wave_id IS NULL").isEmpty()


def test_summary_totals_equal_row_totals(spark, small):
    plan = WavePlan(drops(spark, small), [PLAN])
    totals = plan.wave_summary.agg(F.sum("Total_distro"), F.sum("Total_plts"), F.sum("Total_CandB_locs")).first()
    rows = plan.assigned.agg(F.count("Distro"), F.sum("TotalNumberofPallets"), F.sum("Total_locs")).first()
    assert tuple(totals) == tuple(rows)
    assert tuple(plan.wave_summary.filter("UnitSortable = 'Y'").agg(F.sum("Total_CandB_locs"), F.sum("Total_distro"), F.sum("Total_plts"), F.count("*")).first()) == (13670, 2990, 2055, 79)


@pytest.mark.parametrize(
    ("scenario", "waves", "locations"),
    [(PLAN, 306, 141146), (Scenario(3840, 2, 0.9, "DPCI"), 260, 71072), (Scenario(3842, 2), 456, 139766), (Scenario(3842, 12, 1, "DPCI"), 368, 71458)],
)
def test_known_totals(spark, medium, scenario, waves, locations):
    summary = WavePlan(drops(spark, medium), [scenario]).wave_summary.filter("UnitSortable = 'Y'")
    got = summary.agg(F.count("*"), F.sum("Total_CandB_locs"), F.sum("Total_distro"), F.sum("Total_plts")).first()
    assert tuple(got) == (waves, locations, 30064, 19111)


def test_input_order_does_not_matter(spark, small):
    source = drops(spark, small)
    assert rows_of(WavePlan(source.repartition(5, "VCPWidth"), [PLAN]).assigned) == rows_of(WavePlan(source, [PLAN]).assigned)


def test_waves_follow_release_order(spark, small):
    waves = WavePlan(drops(spark, small), [PLAN]).carton_waves.orderBy(*GROUP, *release_order()).collect()
    for a, b in zip(waves, waves[1:]):
        if (a.drop_id, a.UnitSortable, a.SSZ) == (b.drop_id, b.UnitSortable, b.SSZ):
            assert a.wave_no <= b.wave_no


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"preview"}))
def test_plan_has_no_single_partition_python_or_cross_join(spark, small, name):
    plan = text_plan(QUERIES[name](spark, small))
    for bad in ("SinglePartition", "Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, bad


def test_filter_and_columns_reach_the_scan(spark, small):
    plan = text_plan(QUERIES["dims_canonical"](spark, small))
    lines = [s for s in re.findall(r"ReadSchema: struct<(.*?)>", plan)]
    assert any("l_orderkey" in s for s in lines) and not any("l_tax" in s or "p_name" in s for s in lines)


def test_filter_is_pushed_to_a_stored_table(spark, small, tmp_path):
    from waveplan.operators import filters

    drops(spark, small).write.parquet(str(tmp_path / "drops"))
    stored = spark.read.parquet(str(tmp_path / "drops"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = text_plan(filters.carton_rows(filters.unit_sortable(stored, "Y"), zone=9).select("Distro"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(SSZ,9)" in plan and "EqualTo(UnitSortable,Y)" in plan and "EqualTo(TotalNumberofPallets,0)" in plan
    assert "ReadSchema: struct<Distro:string,SSZ:int,UnitSortable:string,TotalNumberofPallets:bigint>" in plan


def test_zone_filter_on_the_result_reaches_the_input(spark, stored):
    path, _ = stored
    plan = WavePlan(spark.read.parquet(str(path)), [PLAN])
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = text_plan(plan.assigned.filter("SSZ = 9 AND drop_id = 1998"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert text.count("EqualTo(SSZ,9)") >= 2
    plan.close()


def test_shuffles_are_sized_by_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert size_shuffles(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert size_shuffles(spark, 2**40) == 4096 == int(spark.conf.get(key))
    assert size_shuffles(spark, 100 * 2**40) == 400 * 1024
    spark.conf.unset(key)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_empty_input(spark):
    empty = table(spark, [])
    assert WavePlan(empty, [PLAN]).wave_summary.isEmpty()
    assert scenario_sweep(empty, SCENARIOS).isEmpty()


def test_pallets_are_sorted_once_for_all_scenarios(spark, small):
    plan = WavePlan(drops(spark, small), SCENARIOS)
    windows = [line for line in text_plan(plan.placed_pallets).splitlines() if "Window [" in line]
    assert windows and not any("scenario_id" in line for line in windows)
    plan.close()


@pytest.mark.parametrize("cell_rows", [10**6, 300])
def test_scenarios_in_several_lots_give_the_same_summary(spark, small, monkeypatch, cell_rows):
    from waveplan.plans import planner

    found = []
    for beside in (16, 2):
        monkeypatch.setattr(planner, "BESIDE", beside)
        plan = WavePlan(drops(spark, small), [*SCENARIOS[:4], Scenario(3840, 1)], rules=Rules(cell_rows=cell_rows))
        found.append({tuple(r) for r in plan.wave_summary.collect()})
        plan.close()
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2, 3, 4}


@pytest.mark.parametrize("cell_rows", [60, 900])
def test_summary_of_one_zone_in_parts_below_and_above_waves(spark, small, cell_rows):
    source = drops(spark, small).withColumns({"drop_id": F.lit("1"), "UnitSortable": F.lit("Y"), "SSZ": F.lit(3), "DPCI": F.concat(F.lit("i"), F.col("Aisle") % 23)})
    usual, cut = (WavePlan(source, SCENARIOS[:3], rules=Rules(cell_rows=n)) for n in (10**6, cell_rows))
    assert cut._release_parts.levels and cut._parts_below_waves == (cell_rows < 800) and not usual._parts_below_waves
    assert rows_of(cut.wave_summary) == rows_of(usual.wave_summary)
    usual.close(), cut.close()


def test_totals_of_small_parts_move_rows_for_their_order_only(stored, tmp_path):
    """Besides the one row that each part gets, and what finds the charges."""
    path, rows = stored
    body = "from waveplan import Rules; s = [Scenario(3840, 2), Scenario(3840, 2, 0.9, 'DPCI')]; p = WavePlan(source, s, rules=Rules(cell_rows=50)); {}"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    found, _ = event_log(tmp_path / "a", path, body.format("p._release_parts; p.charges.count()"))
    all_, _ = event_log(tmp_path / "b", path, body.format("p.carton_totals.count()"))
    assert all_ - found <= 4 * rows


def test_shuffle_files_of_written_tables_go(spark):
    from waveplan.session import materialize

    def files() -> int:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))

    before, paths = files(), []
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "groups", paths)
    assert files() <= before
    release(spark, paths)


def test_scenarios_that_cannot_be_planned_leave_their_slots_empty(spark, small, monkeypatch):
    from waveplan.plans import planner

    monkeypatch.setattr(planner, "BESIDE", 2)
    chosen = [Scenario(3840, 1), Scenario(3840, 1), PLAN, Scenario(3840, 1), SCENARIOS[1]]
    plan, usual = WavePlan(drops(spark, small), chosen), WavePlan(drops(spark, small), [PLAN, SCENARIOS[1]])
    number = F.when(F.col("scenario_id") == 1, 3).otherwise(5)
    assert rows_of(plan.placed_pallets) == rows_of(usual.placed_pallets.withColumn("scenario_id", number))
    plan.close(), usual.close()
