"""From accepted rows to waves, for all zones and scenarios at once."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.functions.locations import with_distro_locs
from waveplan.functions.text import charging_instructions
from waveplan.operators import assign, cartons, pallets, quality, summary
from waveplan.operators.capacity import BESIDE, Scenario, capacities, numbered, rejected_scenarios
from waveplan.operators.filters import non_pallet, pallet_rows
from waveplan.operators.items import ITEM_FIRST, item_charges, with_item_rank
from waveplan.operators.running import CELL_ROWS, Order, Parts, split
from waveplan.schema import DROPS, GROUP, ITEM
from waveplan.session import cleaned, materialize, release

RESULTS = ["scenario_id", "Total_locs", "wave_id", "Charging Instructions", "rank"]
EXTRAS = "_extras"


@dataclass(frozen=True)
class Rules:
    """Deviations from the default reading of the planning rules.

    ``rank_scope``: ``all_zones`` charges an item kept in several zones once;
    ``zone`` charges it in each. ``fix_level_a``: see ``capacities``.
    ``with_rank`` adds the row's position in its item. ``cell_rows``: rows sorted in one task.
    """

    rank_scope: str = "all_zones"
    fix_level_a: bool = False
    with_rank: bool = False
    cell_rows: int = CELL_ROWS


@dataclass
class WavePlan:
    """The tables of a plan, all lazy but some that are written once to the shared folder when first used:
    ``pallet_running``, a row per pallet item, ``carton_totals``, a row per carton wave, and, if zones are cut, ``charges``.

    ``drops`` must hold accepted rows (see ``operators.quality``). Columns the plan does
    not know travel as one struct, so that no name of theirs can clash, and come out of
    ``assigned`` as they were. ``rejects`` are the rows that :func:`plan_waves` set aside.

    The first use counts the rows once: only groups that could outgrow a task are looked at
    further (see ``operators.running``). A result reads the columns it needs of the input: narrow ones
    for waves and totals, all of them only for ``assigned``, where each row moves once, to its place in its zone.
    """

    drops: DataFrame
    scenarios: list[Scenario]
    aisles: DataFrame | None = None
    rules: Rules = field(default_factory=Rules)
    rejects: DataFrame | None = None
    counts: dict[str, int] | None = None
    written: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        spark = self.drops.sparkSession
        known = {name.lower() for name in [*DROPS.fieldNames(), *RESULTS]}
        self.extras = [c for c in self.drops.columns if c.lower() not in known]
        packed = [F.struct(*[F.col(f"`{c}`") for c in self.extras]).alias(EXTRAS)] if self.extras else []
        self.drops = self.drops.select(*DROPS.fieldNames(), *packed)
        self.capacity = capacities(spark, self.scenarios, self.aisles, self.rules.fix_level_a)
        self.methods = sorted({s.method for s in self.scenarios})

    def close(self) -> None:
        """Delete the written tables, once all results have been used."""
        release(self.drops.sparkSession, self.written)

    @cached_property
    def rejected_scenarios(self) -> DataFrame:
        """Scenarios that yield no rows, with the reason."""
        return rejected_scenarios(self.drops.sparkSession, self.scenarios, self.aisles)

    @cached_property
    def _rows_in_all(self) -> int:
        if self.counts:
            return self.counts["rows"] - self.counts["rejects"]
        with cleaned(self.drops.sparkSession):
            return self.drops.count()

    def _split(self, rows: DataFrame, order: Order) -> Parts:
        return split(rows, GROUP, order, self.rules.cell_rows, self.written, self._rows_in_all)

    @cached_property
    def _release_parts(self) -> Parts:
        return self._split(non_pallet(self.drops), cartons.RELEASE)

    @cached_property
    def _storage_parts(self) -> Parts:
        return self._split(pallet_rows(self.drops), assign.STORAGE)

    @cached_property
    def charges(self) -> DataFrame:
        """The rows that items are charged to (see ``items.item_charges``), written if zones are cut, as
        they are then read more than once."""
        found = item_charges(self.drops, self.rules.rank_scope, cartons.item_zone(self.methods))
        return materialize(found, "charges", self.written) if self._release_parts.levels else found

    @cached_property
    def pallet_running(self) -> DataFrame:
        """Pallet items with their running locations."""
        rollup = pallets.pallet_rollup(self.drops)
        running = pallets.pallet_running(rollup, self.rules.cell_rows, self.written, self._rows_in_all)
        return materialize(running, "pallets", self.written)

    @cached_property
    def running(self) -> DataFrame:
        """Carton rows once for each method with their running locations."""
        return self._running(self.drops)

    def _running(self, rows: DataFrame, bounds: bool = False, apart: bool = False) -> DataFrame:
        """``bounds`` adds those of parts, and where the row's item stood before, but not with ``apart``."""
        released = cartons.release_rows(rows, self.charges, self._release_parts)
        ran = cartons.carton_running(released, self.methods, self._release_parts, bounds)
        if not bounds or apart:
            return cartons.by_method(ran, self.methods, bounds)
        ran = summary.with_item_before(ran, methods=self.methods)
        return cartons.by_method(ran, self.methods, bool(self._release_parts.levels), (summary.ITEM_BEFORE,))

    @cached_property
    def carton_waves(self) -> DataFrame:
        return cartons.carton_waves(self.running, self.capacity)

    @cached_property
    def pallet_waves(self) -> DataFrame:
        return pallets.pallet_waves(self.pallet_running, self.capacity, self.methods)

    @cached_property
    def ends(self) -> DataFrame:
        """Where the cartons of each zone end under each scenario."""
        return cartons.zone_ends(self.running, self.capacity)

    @cached_property
    def _parts_below_waves(self) -> bool:
        """Have parts fewer rows than a wave has locations? Then waves reach over parts, as a row takes about a location."""
        if not self._release_parts.levels:
            return False
        sizes = [r.carton_size for r in self.capacity.select("carton_size").collect()]  # at most one a scenario
        return self.rules.cell_rows < max(sizes, default=0)

    @cached_property
    def carton_totals(self) -> DataFrame:
        """Totals of each carton wave (see ``summary.carton_totals``), of small parts by part and item: these rows move for
        their order only, and meet the pallets' items in the summary."""
        apart, rows = self._parts_below_waves, self.drops
        if not apart:
            stacked = self.pallet_running.select(*ITEM, F.lit(True).alias("on_pallets"))
            rows = rows.join(stacked, ITEM_FIRST, "left")
        beside = min(BESIDE, max(Counter(s.method for s in self.scenarios).values(), default=1))
        scenarios = numbered(self.capacity, beside, ["Method"])
        waved = cartons.waves_beside(self._running(rows, True, apart), scenarios, beside)
        return materialize(summary.totals_beside(waved, scenarios, beside, apart), "totals", self.written)

    def _placed_pallets(self, ends: DataFrame) -> DataFrame:
        rows = with_distro_locs(pallet_rows(self.drops))
        rows = rows.withColumn("Total_locs", F.coalesce("Total_locs", F.lit(1)).cast("bigint"))
        rows = rows.join(self.pallet_running.select(*ITEM, "pallet_cum_locations"), ITEM_FIRST, "left")
        beside = min(BESIDE, max(len(self.scenarios), 1))
        return assign.place_pallets(rows, ends, self.capacity, self._storage_parts, beside, len(self.scenarios))

    @cached_property
    def placed_pallets(self) -> DataFrame:
        """Pallet rows with their placement under every scenario."""
        return self._placed_pallets(self.ends)

    @cached_property
    def placed(self) -> DataFrame:
        placed = assign.place_cartons(self.carton_waves).drop("zone_locations", "wave_id")
        return placed.unionByName(self.placed_pallets, allowMissingColumns=True)

    @cached_property
    def assigned(self) -> DataFrame:
        """Every row once per scenario with wave, locations and charging instructions."""
        rows = assign.assigned(self.placed, self.drops.columns)
        rows = self._ranked(rows) if self.rules.with_rank else rows
        return rows.select(
            *DROPS.fieldNames(),
            *[F.col(EXTRAS)[c].alias(c) for c in self.extras],
            "scenario_id",
            "Total_locs",
            "wave_id",
            *(["rank"] if self.rules.with_rank else []),
            charging_instructions(F.col("VCPHeight")).alias("Charging Instructions"),
        )

    def _ranked(self, rows: DataFrame) -> DataFrame:
        key = [*GROUP, "DPCI", "Distro"]
        ranked = with_item_rank(self.drops, self.rules.rank_scope, self.rules.cell_rows, self.written, self._rows_in_all)
        ranks = ranked.select(*key, "rank")
        return rows.join(ranks, key, "left")

    @cached_property
    def wave_summary(self) -> DataFrame:
        placed = self._placed_pallets(summary.carton_ends(self.carton_totals))
        rows = assign.assigned(placed, self.drops.columns)
        return summary.wave_utilisation(summary.wave_summary(self.carton_totals, rows), self.capacity)


def plan_waves(
    drops: DataFrame,
    scenarios: Scenario | list[Scenario],
    aisles: DataFrame | None = None,
    rules: Rules | None = None,
    check_duplicates: bool = True,
) -> WavePlan:
    """Plan raw rows: set faulty ones aside (``rejects``), then build the tables on the rest.

    The checked rows are written at once, as every result and the rejects read them; ``counts`` says
    how many there were and how many are rejects.
    """
    chosen = [scenarios] if isinstance(scenarios, Scenario) else list(scenarios)
    written: list[str] = []
    good, bad, counts = quality.checked(drops, check_duplicates, written)
    return WavePlan(good, chosen, aisles, rules or Rules(), rejects=bad, counts=counts, written=written)
