"""Files in and out, quality checks, scenario checks, uploads."""

import gzip
import io
from datetime import datetime
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import row, sized_row, table

from waveplan import Scenario, WavePlan, plan_waves
from waveplan.functions.text import clean_headers
from waveplan.operators import filters, quality
from waveplan.operators.capacity import capacities, rejected_scenarios
from waveplan.schema import DROPS
from waveplan import sinks
from waveplan.sinks import publish_assigned, write_assigned
from waveplan.sources.aisles import aisles
from waveplan.sources.conform import to_date, to_number
from waveplan.sources.csv import scan_csv
from waveplan.sources.star import drops
from waveplan.sources.workbooks import scan_workbooks
from waveplan.streaming.uploads import plan_uploads

HEADER = [f.name for f in DROPS if f.name != "drop_id"]
LINE = "007,012,5,Y,7/22/2022,4,18,6,3.0,0,0,10,12.5,20"


def write_csv(path, lines, header=None):
    path.write_text("\n".join([",".join(header or HEADER), *lines]) + "\n")


def test_csv_keys_stay_text_and_drop_is_the_file(spark, tmp_path):
    write_csv(tmp_path / "drop 1.csv", [LINE])
    write_csv(tmp_path / "drop 2.csv", [LINE, LINE.replace("007", "008")])
    found = scan_csv(spark, str(tmp_path)).orderBy("drop_id", "Distro").collect()
    one, two = (f"file:{tmp_path}/drop {n}.csv" for n in (1, 2))
    assert [(r.drop_id, r.Distro, r.DPCI) for r in found] == [(one, "007", "012"), (two, "007", "012"), (two, "008", "012")]
    assert found[0].AllocationRequestDate == datetime(2022, 7, 22)
    assert (found[0].TotalNumberofFullVCPs, found[0].VCPWidth, found[0].bad_date) == (3, 12.5, False)
    assert [f.dataType for f in scan_csv(spark, str(tmp_path)).schema][: len(DROPS)] == [f.dataType for f in DROPS]


def test_csv_headers_are_cleaned_and_extra_columns_stay(spark, tmp_path):
    header = ['"VCP\nHeight"' if h == "VCPHeight" else h.replace("Totalnumber", "Total number") for h in HEADER]
    write_csv(tmp_path / "a.csv", [LINE + ",note"], [*header, "Store Notes"])
    found = scan_csv(spark, str(tmp_path), multi_line=True)
    assert found.first().StoreNotes == "note" and found.first().VCPHeight == 10.0


def test_csv_faulty_lines_are_kept_for_the_rejects(spark, tmp_path):
    lines = [LINE, "009,012,5", LINE.replace("007", "010").replace("7/22/2022", "soon"), LINE.replace("007", "011").replace("3.0", "2.5")]
    write_csv(tmp_path / "a.csv", lines)
    found = {r.Distro: r.reject_reason for r in quality.rejects(scan_csv(spark, str(tmp_path))).collect()}
    assert found == {"009": "bad_line", "010": "bad_date", "011": "bad_quantity"}


def test_a_comma_too_many_shifts_no_fields(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [LINE, LINE.replace("007", "012").replace(",18,", ",1,800,")])
    scanned = scan_csv(spark, str(tmp_path))
    plan = plan_waves(scanned, Scenario(3840, 2))
    assert [r.Distro for r in plan.assigned.collect()] == ["007"]
    assert [r.reject_reason for r in plan.rejects.collect()] == ["bad_line"]
    assert not {"_corrupt_record", "bad_line", "bad_date"} & set(plan.assigned.columns)
    plan.close()


def test_files_of_one_name_are_drops_of_their_own(spark, tmp_path):
    for name in ("a/drop.csv", "b/drop.csv", "c/x.csv", "c/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        write_csv(tmp_path / name, [LINE])
    scanned = scan_csv(spark, [str(tmp_path / n) for n in "abc"])
    plan = plan_waves(scanned, Scenario(3840, 2))
    assert plan.rejects.isEmpty() and plan.assigned.select("drop_id").distinct().count() == 4
    plan.close()


def test_columns_are_found_by_name_in_each_file(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [LINE + ",note"], [*HEADER, "Store Notes"])
    write_csv(tmp_path / "b.csv", [",".join(LINE.split(",")[::-1])], HEADER[::-1])
    write_csv(tmp_path / "c.csv", ["1,2"], ["Distro", "SSZ"])
    with pytest.warns(UserWarning, match="c.csv lacks the columns DPCI"):
        found = scan_csv(spark, str(tmp_path)).orderBy("drop_id").collect()
    assert [(r.Distro, r.VCPWidth, r.StoreNotes, r.bad_line) for r in found] == [("007", 12.5, "note", False), ("007", 12.5, None, False)]


def test_missing_column_is_named(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["1"], ["Distro"])
    with pytest.raises(ValueError, match="SSZ"):
        scan_csv(spark, str(tmp_path))


def test_csv_round_trip(spark, small, tmp_path):
    source = drops(spark, small).filter("drop_id = 1998").withColumn("drop_id", F.lit("x"))
    source.drop("drop_id").coalesce(1).write.option("header", True).csv(str(tmp_path / "out"))
    back = scan_csv(spark, str(tmp_path / "out")).withColumn("drop_id", F.lit("x"))
    back = back.select(*source.columns)
    assert source.exceptAll(back).isEmpty() and back.exceptAll(source).isEmpty()


def test_workbooks(spark, tmp_path):
    """The decoder is given; here a workbook is a pickled sheet with spaced headers."""
    sheet = pd.DataFrame(
        [["007", "012", 5, "Y", datetime(2022, 7, 22), 4, 18, 6, 3, 0, 0, 10.0, None, 20.0, "n"]],
        columns=[h.replace("VCP", "VCP\n ") for h in HEADER] + ["Store Notes"],
    )
    (tmp_path / "b 1.xlsx").write_bytes(sheet.to_csv(index=False).encode())

    def decoder(content: bytes) -> pd.DataFrame:
        return pd.read_csv(io.BytesIO(content), dtype={"Distro": str, "DPCI": str})

    found = scan_workbooks(spark, str(tmp_path), decoder, extra_columns=("StoreNotes",)).first()
    assert (found.drop_id, found.Distro, found.DPCI, found.SSZ) == (f"file:{tmp_path}/b 1.xlsx", "007", "012", 5)
    assert (found.VCPHeight, found.VCPWidth, found.StoreNotes) == (10.0, None, "n")
    assert found.AllocationRequestDate == datetime(2022, 7, 22)


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("3",), ("3.0",), ("3.5",), ("x",), (None,), ("-2",)], "s string")
    assert [r[0] for r in df.select(to_number(df.s)).collect()] == [3, 3, None, None, None, -2]
    dates = ["2022-07-22", "2022-07-22 05:06:07", "7/22/2022", "7/22/22", "7/22/2022 5:06", "20220722", "nope"]
    df = spark.createDataFrame([(d,) for d in dates], "s string")
    day = datetime(2022, 7, 22)
    assert [r[0] for r in df.select(to_date(df.s)).collect()] == [
        day, datetime(2022, 7, 22, 5, 6, 7), day, day, datetime(2022, 7, 22, 5, 6), day, None,
    ]


def test_clean_headers(spark):
    assert clean_headers(spark.createDataFrame([(1, 2)], "`a b` int, `c\nd ` int")).columns == ["ab", "cd"]


def test_reject_reasons(spark):
    nan = float("nan")
    rows = [
        row("ok"),
        row("nan", VCPWidth=nan),
        row("none", VCPLength=None),
        row("zero", VCPHeight=0.0),
        row("pack", SSPsinVCP=0),
        row("neg", TotalNumberofPallets=-1),
        row("gone", TotalNumberofLooseSSP=None),
        row("key", SSZ=None),
        row("free", TotalNumberofSSPsintheDistro=None),
        row("late", AllocationRequestDate=None, Aisle=None),
        row("twice", DPCI="x"),
        row("twice", DPCI="x", Aisle=7),
        row("two zones", DPCI="x"),
        row("two zones", DPCI="x", SSZ=4),
    ]
    tagged = quality.tag(table(spark, rows))
    assert {r.Distro: r.reject_reason for r in tagged.collect()} == {
        "ok": None, "nan": "bad_dimension", "none": "bad_dimension", "zero": "bad_dimension",
        "pack": "bad_quantity", "neg": "bad_quantity", "gone": "bad_quantity", "key": "missing_key",
        "free": None, "late": None, "twice": "duplicate_key", "two zones": None,
    }
    assert tagged.count() == len(rows)
    plan = plan_waves(table(spark, rows), Scenario(3840, 2))
    assert (plan.assigned.count(), plan.rejects.count()) == (5, len(rows) - 5)
    plan.close()


def test_aisles(spark):
    """The table once more, in the order of the aisles: usable locations of each centre."""
    usable = {
        (3840, 1): [54, 862, 880, 862, 878, 864, 920, 862, 796, 812, 876, 888, 618, 99],
        (3841, 2): [778, 778, 778, 778, 778, 778, 778, 778, 778, 778, 778, 778, 46],
        (3842, 1): [58, 500, 509, 500, 509, 500, 509, 446, 500, 500, 386, 386, 386, 386, 386, 56],
    }
    only_pallets = {(3840, 1), (3840, 14), (3842, 1), (3842, 16), (3841, 14)}
    expected = set()
    for (udc, first), locations in usable.items():
        for aisle, n in enumerate(locations, first):
            pallet = n if (udc, aisle) in only_pallets else 8
            expected.add((udc, aisle, pallet, n, n - pallet))
    rows = [tuple(r) for r in aisles(spark).collect()]
    assert len(rows) == 43 and set(rows) == expected


@pytest.mark.parametrize("fix", [False, True])
def test_level_a(spark, fix):
    wanted = {  # carton locations, practical locations, practical locations with the fix
        (3842, 2): (492 + 163, 500 + 163, 500 + 163),
        (3842, 10): (492 + 163, 500 + 163, 500 + 163),
        (3842, 11): (378 + 127, 386, 386 + 127),
        (3842, 14): (378 + 127, 386, 386 + 127),
        (3842, 15): (378, 386, 386),
        (3840, 2): (854, 862 + 163, 862),
        (3840, 11): (868, 876, 876),
        (3841, 10): (770, 778 + 163, 778),
    }
    scenarios = [Scenario(u, a, 0.8, "Distro", True) for u, a in wanted]
    found = {(r.UDC, r.Aisle_No): r for r in capacities(spark, scenarios, fix_level_a=fix).collect()}
    for key, (carton, practical, fixed) in wanted.items():
        assert found[key].carton_locations == carton and found[key].carton_size == 0.8 * carton
        assert found[key].practical_locations == (fixed if fix else practical)


def test_rejected_scenarios(spark):
    scenarios = [Scenario(3840, 2), Scenario(3840, 1), Scenario(3841, 1), Scenario(1, 1)]
    found = [(r.scenario_id, r.reject_reason) for r in rejected_scenarios(spark, scenarios).orderBy("scenario_id").collect()]
    assert found == [(2, "no_carton_capacity"), (3, "unknown_aisle"), (4, "unknown_aisle")]
    plan = WavePlan(table(spark, [sized_row("a", 5)]), scenarios)
    assert [r.scenario_id for r in plan.assigned.collect()] == [1]
    assert plan.rejected_scenarios.count() == 3
    plan.close()
    with pytest.raises(ValueError):
        Scenario(3840, 2, method="Pallet")
    for cap in (0, -0.5, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="cap"):
            Scenario(3840, 2, cap)


def test_faulty_aisles_are_rejected(spark):
    own = aisles(spark).filter("UDC = 3842 AND Aisle_No IN (2, 3, 4)")
    own = own.union(own.filter("Aisle_No = 3")).withColumn(
        "Pallet Locations", F.when(F.col("Aisle_No") == 4, 0).otherwise(F.col("Pallet Locations"))
    )
    scenarios = [Scenario(3842, 2), Scenario(3842, 3), Scenario(3842, 4)]
    found = rejected_scenarios(spark, scenarios, own).orderBy("scenario_id").collect()
    assert [(r.scenario_id, r.reject_reason) for r in found] == [(2, "repeated_aisle"), (3, "no_pallet_locations")]
    plan = WavePlan(table(spark, [sized_row("a", 5), row("p", TotalNumberofPallets=4)]), scenarios, own)
    assert sorted((r.Distro, r.scenario_id) for r in plan.assigned.collect()) == [("a", 1), ("p", 1)]
    plan.close()


def test_unknown_columns_pass_through_whatever_their_name(spark):
    source = table(spark, [sized_row("a", 5), row("p", TotalNumberofPallets=4)]).selectExpr(
        "*", "'n' AS `Store Notes`", "7 AS UDC", "8 AS method", "9 AS vcp", "'old' AS wave_id", "1.5 AS Ht"
    )
    plan = plan_waves(source, Scenario(3840, 2))
    found = plan.assigned.collect()
    assert {(r["Store Notes"], r.UDC, r.method, r.vcp, float(r.Ht)) for r in found} == {("n", 7, 8, 9, 1.5)}
    assert {r.wave_id for r in found} == {"W1"} and plan.assigned.columns.count("wave_id") == 1
    assert plan.wave_summary.count() == 1
    plan.close()


def test_export_keeps_the_users_columns(spark, tmp_path):
    names = ["pallets", "vcp", "VCPHt", "pallet_loc", "wave_cum_locations", "wave_no"]
    source = table(spark, [sized_row("a", 5)]).selectExpr("*", *[f"'mine' AS {n}" for n in names])
    plan = WavePlan(source, [Scenario(3840, 2)])
    write_assigned(plan.assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).first()
    assert [back[n] for n in names] == ["mine"] * 6
    plan.close()


def test_own_aisles(spark):
    own = aisles(spark).filter("UDC = 3842").withColumn("UDC", F.lit(7))
    assert [r.carton_locations for r in capacities(spark, [Scenario(7, 2)], own).collect()] == [492]


def test_preview_and_dates(spark, small):
    source = drops(spark, small)
    assert filters.preview(source).count() == 5
    day = source.selectExpr("min(AllocationRequestDate)").first()[0]
    inside = filters.date_range(source, day, day).select("AllocationRequestDate").distinct().collect()
    assert [r[0] for r in inside] == [day]


@pytest.mark.parametrize("file_format", ["parquet", "csv", "json"])
def test_export(spark, small, tmp_path, file_format):
    plan = WavePlan(drops(spark, small), [Scenario(3840, 2)])
    path = str(tmp_path / "out")
    write_assigned(plan.assigned, path, file_format)
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    back = reader.format(file_format).load(path)
    assert back.count() == 6000
    assert {"drop_id", "SSZ", "wave_id", "Total_locs", "Charging Instructions"} <= set(back.columns)
    assert back.filter("drop_id = 1998 AND SSZ = 4").count() == plan.assigned.filter("drop_id = 1998 AND SSZ = 4").count()


def test_uploads_are_planned_as_they_arrive(spark, tmp_path):
    inbox, outbox, mark = (tmp_path / n for n in ("in", "out", "mark"))
    inbox.mkdir()
    write_csv(inbox / "mon.csv", [LINE, LINE.replace("007", "008"), "bad,,,,,,,,,,,,,"])

    def go():
        plan_uploads(spark, str(inbox), str(outbox), str(mark), [Scenario(3840, 2)]).awaitTermination()

    go()
    write_csv(inbox / "tue.csv", [",".join(LINE.split(",")[::-1])], HEADER[::-1])
    write_csv(inbox / "odd.csv", ["1"], ["Distro"])
    go()
    found = spark.read.parquet(str(outbox / "assigned")).select("drop_id", "Distro", "wave_id", "batch").collect()
    found = sorted((r.drop_id.split("/")[-1], *r[1:]) for r in found)
    assert found == [("mon.csv", "007", "W1", 0), ("mon.csv", "008", "W1", 0), ("tue.csv", "007", "W1", 1)]
    assert spark.read.parquet(str(outbox / "bad_files")).first()["file"].endswith("/odd.csv")
    assert spark.read.parquet(str(outbox / "rejects")).select("reject_reason").collect() == [("missing_key",)]
    assert spark.read.parquet(str(outbox / "summary")).agg(F.sum("Total_distro")).first()[0] == 3


def test_uploads_whose_names_hold_spaces(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write_csv(inbox / "drop 1+2%.csv", [LINE])
    plan_uploads(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "mark"), [Scenario(3840, 2)]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/assigned")).first().drop_id.endswith("/drop 1+2%.csv")


def test_headers_are_read_without_the_rest_of_the_file(spark, tmp_path):
    """A line of a wrong kind behind the first buffer is never seen, and large files cost no more than small ones."""
    from waveplan.sources.csv import file_headers

    write_csv(tmp_path / "large.csv", [LINE] * 400_000)
    write_csv(tmp_path / "small.csv", [LINE], HEADER[::-1])
    (tmp_path / "quoted.csv").write_text('"a\n""b",c\n1,2\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "open.csv").write_text('a,"b\nc')
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as packed:
        packed.write("x,y\r\n1,2\r\n")
    names = lambda found: {record: [f.split("/")[-1] for f in files] for record, files in found.items()}
    plain = {",".join(HEADER): ["large.csv"], ",".join(HEADER[::-1]): ["small.csv"], "x,y": ["packed.csv.gz"]}
    assert names(file_headers(spark, str(tmp_path), False)) == plain | {'"a': ["quoted.csv"], 'a,"b': ["open.csv"]}
    assert names(file_headers(spark, str(tmp_path), True)) == plain | {'"a\n""b",c': ["quoted.csv"], 'a,"b\nc': ["open.csv"]}


def test_records_longer_than_a_block(spark, tmp_path, monkeypatch):
    from waveplan.sources import csv

    monkeypatch.setattr(csv, "BLOCK", 4)
    (tmp_path / "a.csv").write_text('"é\né",日本語\n1,2\n')
    assert list(csv.file_headers(spark, str(tmp_path), True)) == ['"é\né",日本語']
    assert csv.record_end('a,b\r\n', False) == 3 and csv.record_end("a,b", True) is None


def published(spark, path, file_format="parquet"):
    found = sinks.manifests(spark, path).collect()
    back = spark.read.option("header", True).format(file_format).load(path)
    counts = {f"drop_id={r.drop_id}": r["count"] for r in back.groupBy("drop_id").count().collect()}
    assert counts == {r["drop"]: r["rows"] for r in found}
    for r in found:
        files = {p.relative_to(f"{path}/{r['drop']}").as_posix() for p in Path(f"{path}/{r['drop']}").rglob("part-*")}
        assert {f["file"] for f in r["files"]} == files and all(f["bytes"] > 0 for f in r["files"])
    return {r["drop"]: r["run"] for r in found}


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_a_repeated_export_leaves_one_result(spark, tmp_path, file_format):
    path = str(tmp_path / "out")
    rows = [sized_row(f"{d}{z}", 5, drop_id=d, SSZ=z) for d in "ab" for z in (1, 2, 3)]
    plan = WavePlan(table(spark, rows), [Scenario(3840, 2)])
    first = publish_assigned(plan.assigned, path, file_format)
    assert published(spark, path, file_format) == {"drop_id=a": first, "drop_id=b": first}
    # the drop comes again, without one of its zones; the other drop stays
    again = publish_assigned(plan.assigned.filter("drop_id = 'a' AND SSZ < 3"), path, file_format)
    assert published(spark, path, file_format) == {"drop_id=a": again, "drop_id=b": first}
    assert sorted(p.name for p in (tmp_path / "out/drop_id=a").iterdir()) == ["SSZ=1", "SSZ=2"]
    assert not list((tmp_path / "out/_staged").iterdir())


def test_a_failed_export_changes_nothing_and_a_committed_one_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    rows = [sized_row(d, 5, drop_id=d) for d in "abc"]
    plan = WavePlan(table(spark, rows), [Scenario(3840, 2)])
    first = publish_assigned(plan.assigned, path)
    write, move = sinks._Folder.write, sinks._Folder.move

    def fail_to_commit(self, text, *names):
        if names[-1] == sinks.COMMITTED:
            raise OSError("lost")
        write(self, text, *names)

    monkeypatch.setattr(sinks._Folder, "write", fail_to_commit)
    with pytest.raises(OSError):
        publish_assigned(plan.assigned, path)
    assert set(published(spark, path).values()) == {first}
    monkeypatch.setattr(sinks._Folder, "write", write)
    for moved in range(6):
        done = []

        def fail_to_move(self, source, target):
            if len(done) == moved:
                raise OSError("lost")
            done.append(target)
            move(self, source, target)

        monkeypatch.setattr(sinks._Folder, "move", fail_to_move)
        with pytest.raises(OSError):
            publish_assigned(plan.assigned, path)
        monkeypatch.setattr(sinks._Folder, "move", move)
        sinks.finish(spark, path)
        runs = published(spark, path)
        assert len(set(runs.values())) == 1 and len(runs) == 3 and first not in runs.values()
    sinks.clean_staged(spark, path)
    assert not (tmp_path / "out/_staged").exists() and len(published(spark, path)) == 3


def test_an_empty_export_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    plan = WavePlan(table(spark, [sized_row("a", 5)]), [Scenario(3840, 2)])
    first = publish_assigned(plan.assigned, path)
    publish_assigned(plan.assigned.filter("drop_id = 'none'"), path)
    assert published(spark, path) == {"drop_id=a": first}
