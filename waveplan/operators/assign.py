"""Final waves of carton and pallet rows.

A carton's wave is a projection of its running sum. Pallet policy depends on where the
cartons of a zone end under a scenario, a table of zones and scenarios that the pallet rows
are joined with; pallets behind that end are summed up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.functions.text import wave_label
from waveplan.operators.capacity import BESIDE, lots, numbered
from waveplan.operators.cartons import wave_number
from waveplan.operators.pallets import pallet_wave_number
from waveplan.operators.running import Order, Parts, running_sum, same_join
from waveplan.schema import GROUP

# Policy for pallets left after the last carton wave.
OWN_WAVE_ABOVE = 50
ROOM_LEFT_BELOW = 0.8
SHARING_CENTRE = 3840


STORAGE = Order("Aisle", None, "Distro", ("DPCI",))


def place_cartons(waves: DataFrame) -> DataFrame:
    return waves.withColumn("placement", F.lit("carton"))


def place_pallets(pallets: DataFrame, ends: DataFrame, capacity: DataFrame, parts: Parts, beside: int = BESIDE, in_all: int = 1) -> DataFrame:
    """Every pallet row with its placement facts under every scenario of its method.

    ``pallets`` are rows with their item's running locations, ``ends`` the last carton waves of zones.
    ``placement`` is ``kept`` (beside a carton wave); ``own`` (trailing pallets above the limit fill a
    wave of their own); ``last`` (few, and the last carton wave has room) or ``extra``. A zone without
    cartons has no last wave: all its pallets trail, and there is no wave with room. ``parts`` is the
    tree of pallet rows by zone in storage order. That order serves all scenarios: what trails under each is summed up
    in columns beside each other, ``beside`` at most in one row, and only then rows are multiplied by scenarios, of which
    there are ``in_all``, or less.
    """
    # zones meet rows before these are multiplied by scenarios, so what moves does not depend on their number
    end = F.struct("scenario_id", F.struct(F.col("n_waves").alias("wave_no"), F.col("last_wave_fill").alias("_fill")))
    last = ends.groupBy(*GROUP).agg(F.map_from_entries(F.collect_list(end)).alias("_ends"))
    rows = parts.deal(same_join(pallets, last, GROUP, "left"))
    # ``capacity`` has one row per scenario passed in.
    scenarios, slots = numbered(capacity, beside), range(beside)
    rows = rows.withColumn("_lot", F.explode(F.array(*[F.lit(k) for k in range(max(1, -(-in_all // beside)))])))
    rows = rows.join(F.broadcast(lots(scenarios, beside, {"_size_": "pallet_size", "_id_": "scenario_id"})), "_lot")
    found = {j: F.try_element_at("_ends", F.col(f"_id_{j}")) for j in slots}
    rows = rows.withColumns(
        {f"_no_{j}": F.coalesce(found[j]["wave_no"], F.lit(0)) for j in slots} | {f"_fill_{j}": found[j]["_fill"] for j in slots}
    ).drop("_ends")
    trails = {j: F.coalesce(pallet_wave_number(f"_size_{j}") > F.col(f"_no_{j}"), F.lit(False)) for j in slots}
    rows = rows.withColumns(
        {f"_left_{j}": F.when(trails[j], F.col("Total_locs")) for j in slots}
        | {f"_pallets_{j}": F.when(trails[j], F.col("TotalNumberofPallets")) for j in slots}
    ).drop(*[f"{c}_{j}" for c in ("_size", "_id") for j in slots])
    rows = running_sum(
        rows, [*GROUP, "_lot"], STORAGE, [f"_left_{j}" for j in slots], [f"_sum_{j}" for j in slots],
        total={f"_pallets_{j}": f"_all_{j}" for j in slots}, parts=parts, dealt=True,
    )
    named = {"_no": "wave_no", "_fill": "_fill", "_sum": "trailing_locations", "_all": "trailing_pallets"}
    each = [F.struct(F.lit(j).alias("_slot"), *[F.col(f"{c}_{j}").alias(name) for c, name in named.items()]) for j in slots]
    own = [c for c in pallets.columns if c not in named.values()]
    rows = rows.select(*own, "_lot", F.explode(F.array(*each)).alias("_of")).select(*own, "_lot", "_of.*")
    rows = rows.join(F.broadcast(scenarios), ["_lot", "_slot"]).withColumn("pallet_wave_no", pallet_wave_number())
    trailing = F.coalesce(F.col("pallet_wave_no") > F.col("wave_no"), F.lit(False))
    room = (F.col("_fill") < F.col("carton_size") * F.lit(ROOM_LEFT_BELOW)) & (F.col("UDC") == SHARING_CENTRE)
    placement = (
        F.when(~trailing, "kept")
        .when(F.col("trailing_pallets") > OWN_WAVE_ABOVE, "own")
        .when(room, "last")
        .otherwise("extra")
    )
    behind = {c: F.when(trailing, F.col(c)) for c in ("trailing_locations", "trailing_pallets")}
    return rows.withColumns({"placement": placement, **behind}).drop("_fill", "_lot", "_slot")


def assigned(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The wave of every row; pallets outside the carton area occupy no locations.

    ``Method`` stays next to the scenario, because rows are partitioned by it.
    """
    place = F.col("placement")
    wave = (
        F.when(place == "carton", wave_label("W", F.col("wave_no")))
        .when(place == "kept", wave_label("W", F.col("pallet_wave_no")))
        .when(place == "own", "Pallet_wave")
        .when(place == "last", wave_label("W", F.col("wave_no")))
        .otherwise(wave_label("W_P", wave_number("trailing_locations")))
    )
    in_aisle = place.isin("carton", "last", "extra")
    return placed.select(
        *columns,
        "Method",
        "scenario_id",
        F.when(in_aisle, F.col("Total_locs")).alias("Total_locs"),
        wave.alias("wave_id"),
    )
