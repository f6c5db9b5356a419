"""The same results as plain SQL, written from the planning rules.

Only the ``drops`` view and the aisle values are shared with the queries.
"""

from __future__ import annotations

from waveplan.operators.capacity import Scenario
from waveplan.plans.catalog import DATES, DEFAULT, LOOKUPS, SCENARIOS
from waveplan.plans.scenarios import all_scenarios
from waveplan.sources.aisles import aisle_rows
from waveplan.sources.star import FAULTY_COLUMNS, STACKED_COLUMNS, select_text

DROPS = f"drops AS ({select_text()})"
KEYS = "drop_id, UnitSortable, SSZ"


def _location_chain(name: str, source: str) -> list[str]:
    """Steps from sides h, w, l and vcp, ssp, Ratio of ``source`` to ``name``."""
    extra_box = "(CASE WHEN Ratio > 0.5 THEN 1 ELSE 0 END)"
    return [
        f"{name}_1 AS (SELECT *, list_sort([h, w, l]) AS sides FROM {source})",
        f"{name}_2 AS (SELECT *, sides[1] AS Ht, sides[2] AS Wt, sides[3] AS Lt FROM {name}_1)",
        f"""{name}_3 AS (SELECT *, CAST(ceil(Wt / 15.5) AS BIGINT) AS Loc_wt,
          CAST(floor(92.5 / Lt) AS BIGINT) AS Loc_lt,
          CAST(CASE WHEN Ht <= 5 THEN 2 ELSE 0 END AS INTEGER) AS Loc_ht1,
          CAST(CASE WHEN Ht <= 5 THEN ceil(10 / Ht) ELSE 0 END AS BIGINT) AS Loc_ht2 FROM {name}_2)""",
        f"""{name}_4 AS (SELECT *, CAST(CASE WHEN Loc_ht1 > 0 THEN Loc_ht1 + (Loc_lt - 1) * Loc_ht2
          ELSE Loc_lt END AS BIGINT) AS Loc_tot FROM {name}_3)""",
        f"{name}_5 AS (SELECT *, CAST(Loc_tot - vcp - {extra_box} AS BIGINT) AS Loc_vcp_rmng FROM {name}_4)",
        f"""{name}_6 AS (SELECT *, CAST(CASE WHEN Loc_vcp_rmng <= 0
          THEN Loc_wt * ceil(abs(Loc_vcp_rmng / NULLIF(Loc_tot, 0))) ELSE 0 END + Loc_wt AS BIGINT) AS Loc_extra
          FROM {name}_5)""",
        f"""{name}_7 AS (SELECT *, CAST(CASE WHEN (Loc_extra * Loc_tot - vcp - {extra_box}) * Lt > CAST(7.7 AS DOUBLE)
          THEN 1 ELSE 0 END AS INTEGER) AS Loc_tray,
          CAST(CASE WHEN vcp = 0 AND ssp > 0 THEN 1 ELSE 0 END AS INTEGER) AS Loose_ssp_flag FROM {name}_6)""",
        f"""{name} AS (SELECT *, CAST(CASE WHEN Loc_tray = 0 THEN 1 ELSE 0 END AS INTEGER) AS Loc_extra_tray,
          CAST(CASE WHEN Loose_ssp_flag = 1 THEN CASE WHEN Ratio > 0 THEN 1 ELSE 0 END
          ELSE Loc_extra + (CASE WHEN Loc_tray = 0 THEN 1 ELSE 0 END) END AS BIGINT) AS locs FROM {name}_7)""",
    ]


BY_ROW = [
    """row_in AS (SELECT *, TotalNumberofFullVCPs AS vcp, TotalNumberofLooseSSP AS ssp,
      TotalNumberofLooseSSP / NULLIF(SSPsinVCP, 0) AS Ratio,
      VCPHeight AS h, VCPWidth AS w, VCPLength AS l FROM drops)""",
    *_location_chain("by_row", "row_in"),
]
ROLLUP = f"""rollup_items AS (SELECT {KEYS}, DPCI, CAST(sum(TotalNumberofFullVCPs) AS BIGINT) AS vcp1,
  CAST(sum(TotalNumberofLooseSSP) AS BIGINT) AS ssp, CAST(sum(TotalNumberofPallets) AS BIGINT) AS pallet,
  max(SSPsinVCP) AS ssp_q, max(VCPHeight) AS vend_cspk_ht_q, max(VCPWidth) AS vend_cspk_wth_q,
  max(VCPLength) AS vend_cspk_lgth_q
  FROM drops WHERE TotalNumberofPallets = 0 GROUP BY {KEYS}, DPCI)"""
BY_ITEM = [
    ROLLUP,
    """item_in AS (SELECT *, CAST(vcp1 + floor(ssp / NULLIF(ssp_q, 0)) AS BIGINT) AS vcp,
      ssp / NULLIF(ssp_q, 0) - floor(ssp / NULLIF(ssp_q, 0)) AS Ratio,
      vend_cspk_ht_q AS h, vend_cspk_wth_q AS w, vend_cspk_lgth_q AS l FROM rollup_items)""",
    *_location_chain("by_item", "item_in"),
]


def _masked(name: str, scope: str) -> str:
    return f"""{name} AS (SELECT d.*, d.rank, CAST(CASE WHEN d.rank > 1 THEN 0 ELSE i.locs END AS BIGINT) AS locs
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {scope} ORDER BY Distro DESC) AS BIGINT) AS rank
            FROM drops WHERE TotalNumberofPallets = 0) d
      LEFT JOIN by_item i ON i.drop_id = d.drop_id AND i.UnitSortable = d.UnitSortable AND i.SSZ = d.SSZ AND i.DPCI = d.DPCI)"""


MASKED = _masked("masked", "drop_id, UnitSortable, DPCI").replace("d.*, d.rank,", "d.*,")
SIZED = """sized AS (
  SELECT 'Distro' AS Method, Distro, DPCI, drop_id, UnitSortable, SSZ, Aisle, AllocationRequestDate,
    coalesce(locs, 1) AS Total_locs FROM by_row WHERE TotalNumberofPallets = 0 AND SSZ <> 2
  UNION ALL SELECT 'Distro', Distro, DPCI, drop_id, UnitSortable, SSZ, Aisle, AllocationRequestDate,
    coalesce(locs, 1) FROM masked WHERE SSZ = 2
  UNION ALL SELECT 'DPCI', Distro, DPCI, drop_id, UnitSortable, SSZ, Aisle, AllocationRequestDate,
    coalesce(locs, 1) FROM masked)"""
RUNNING = """running AS (SELECT *, CAST(sum(Total_locs) OVER (PARTITION BY Method, drop_id, UnitSortable, SSZ
  ORDER BY AllocationRequestDate, Aisle, Distro ROWS UNBOUNDED PRECEDING) AS BIGINT) AS wave_cum_locations FROM sized)"""
TO_RUNNING = [DROPS, *BY_ROW, *BY_ITEM, MASKED, SIZED, RUNNING]


def _scenarios(scenarios: list[Scenario]) -> list[str]:
    aisles = ", ".join(str(row) for row in aisle_rows())
    chosen = ", ".join(
        f"({i}, {s.udc}, {s.aisle}, CAST({s.cap} AS DOUBLE), '{s.method}', {str(s.level_a).lower()})"
        for i, s in enumerate(scenarios, start=1)
    )
    return [
        f"aisles AS (SELECT * FROM (VALUES {aisles}) t(UDC, Aisle_No, pallet_locs, usable_locs, cb_locs))",
        f"""choices AS (SELECT * FROM (VALUES {chosen}) t(scenario_id, UDC, Aisle_No, Cap, Method, Level_A))""",
        """capacity AS (SELECT c.scenario_id, c.UDC, c.Aisle_No, c.Cap, c.Method, c.Level_A,
          a.pallet_locs AS pallet_size,
          a.cb_locs + CASE WHEN c.Level_A AND c.UDC = 3842 AND c.Aisle_No BETWEEN 2 AND 10 THEN 163
            WHEN c.Level_A AND c.UDC = 3842 AND c.Aisle_No BETWEEN 11 AND 14 THEN 127 ELSE 0 END AS carton_locations,
          c.Cap * (a.cb_locs + CASE WHEN c.Level_A AND c.UDC = 3842 AND c.Aisle_No BETWEEN 2 AND 10 THEN 163
            WHEN c.Level_A AND c.UDC = 3842 AND c.Aisle_No BETWEEN 11 AND 14 THEN 127 ELSE 0 END) AS carton_size,
          a.usable_locs + CASE WHEN c.Level_A AND c.Aisle_No BETWEEN 2 AND 10 THEN 163 ELSE 0 END AS practical_locations
          FROM choices c JOIN aisles a ON a.UDC = c.UDC AND a.Aisle_No = c.Aisle_No WHERE a.cb_locs > 0)""",
    ]


WAVES = [
    """waves AS (SELECT r.*, c.scenario_id, c.carton_size, CAST(ceil(r.wave_cum_locations / c.carton_size) AS BIGINT) AS wave_no
      FROM running r JOIN capacity c ON c.Method = r.Method)""",
    f"""last_no AS (SELECT scenario_id, {KEYS}, max(wave_no) AS last_wave FROM waves GROUP BY scenario_id, {KEYS})""",
    """last_waves AS (SELECT n.*, (SELECT CAST(sum(w.Total_locs) AS BIGINT) FROM waves w WHERE w.scenario_id = n.scenario_id
      AND w.drop_id = n.drop_id AND w.UnitSortable = n.UnitSortable AND w.SSZ = n.SSZ AND w.wave_no = n.last_wave) AS last_fill
      FROM last_no n)""",
]
PALLET_ITEMS = f"""pallet_items AS (SELECT {KEYS}, DPCI, CAST(sum(TotalNumberofPallets) AS BIGINT) AS pallets,
  CAST(sum(TotalNumberofFullVCPs) AS BIGINT) AS vcp, avg(VCPHeight) AS VCPHt
  FROM drops WHERE TotalNumberofPallets > 0 GROUP BY {KEYS}, DPCI)"""
PALLET_RUNNING = f"""pallet_run AS (SELECT *, CAST(ceil(pallets / 3) AS BIGINT) AS pallet_loc,
  CAST(sum(ceil(pallets / 3)) OVER (PARTITION BY {KEYS} ORDER BY vcp DESC, VCPHt DESC, DPCI ROWS UNBOUNDED PRECEDING) AS BIGINT)
    AS pallet_cum_locations FROM pallet_items)"""
PALLETS = [
    PALLET_ITEMS,
    PALLET_RUNNING,
    """pallet_waves AS (SELECT p.*, c.scenario_id, c.UDC, c.pallet_size, c.carton_size,
      CAST(ceil(p.pallet_cum_locations / c.pallet_size) AS BIGINT) AS wave_no FROM pallet_run p CROSS JOIN capacity c)""",
]
_SAME_ZONE = "{a}.drop_id = {b}.drop_id AND {a}.UnitSortable = {b}.UnitSortable AND {a}.SSZ = {b}.SSZ"
PLACED = [
    f"""pallet_known AS (SELECT d.*, p.scenario_id, p.UDC, p.carton_size, p.wave_no AS pallet_wave_no,
      coalesce(n.last_wave, 0) AS last_wave, n.last_fill
      FROM drops d JOIN pallet_waves p ON {_SAME_ZONE.format(a='d', b='p')} AND d.DPCI = p.DPCI
      LEFT JOIN last_waves n ON n.scenario_id = p.scenario_id AND {_SAME_ZONE.format(a='n', b='p')}
      WHERE d.TotalNumberofPallets > 0)""",
    f"""left_over AS (SELECT scenario_id, {KEYS}, CAST(sum(TotalNumberofPallets) AS BIGINT) AS trailing_pallets
      FROM pallet_known WHERE pallet_wave_no > last_wave GROUP BY scenario_id, {KEYS})""",
    f"""pallet_placed AS (SELECT k.*, o.trailing_pallets, CASE WHEN k.pallet_wave_no <= k.last_wave THEN 'kept'
      WHEN o.trailing_pallets > 50 THEN 'own'
      WHEN k.last_fill < CAST(0.8 AS DOUBLE) * k.carton_size AND k.UDC = 3840 THEN 'last' ELSE 'extra' END AS placement
      FROM pallet_known k LEFT JOIN left_over o ON o.scenario_id = k.scenario_id AND {_SAME_ZONE.format(a='o', b='k')})""",
    f"""few AS (SELECT p.*, coalesce(r.locs, 1) AS Total_locs, sum(coalesce(r.locs, 1)) OVER (
      PARTITION BY p.scenario_id, p.drop_id, p.UnitSortable, p.SSZ ORDER BY p.Aisle, p.Distro ROWS UNBOUNDED PRECEDING) AS cum
      FROM pallet_placed p JOIN by_row r ON r.Distro = p.Distro WHERE p.placement IN ('last', 'extra'))""",
    f"""plan AS (
      SELECT scenario_id, Distro, 'W' || wave_no AS wave_id, Total_locs FROM waves
      UNION ALL SELECT scenario_id, Distro, CASE WHEN placement = 'own' THEN 'Pallet_wave' ELSE 'W' || pallet_wave_no END,
        CAST(NULL AS BIGINT) FROM pallet_placed WHERE placement IN ('kept', 'own')
      UNION ALL SELECT scenario_id, Distro, CASE WHEN placement = 'last' THEN 'W' || last_wave
        ELSE 'W_P' || CAST(ceil(cum / carton_size) AS BIGINT) END, Total_locs FROM few)""",
    """rows_planned AS (SELECT d.*, p.scenario_id, p.wave_id, p.Total_locs,
      CASE WHEN d.VCPHeight > 15 THEN 'Charge to Top Level' ELSE 'Level A & B' END AS "Charging Instructions"
      FROM plan p JOIN drops d ON d.Distro = p.Distro)""",
]
SUMMARY = [
    f"""totals AS (SELECT scenario_id, {KEYS}, wave_id,
      CAST(sum(TotalNumberofPallets) AS BIGINT) AS Total_plts,
      CAST(coalesce(sum(TotalNumberofFullVCPs) FILTER (WHERE TotalNumberofPallets > 0), 0) AS BIGINT) AS Total_plts_ssps,
      CAST(sum(TotalNumberofFullVCPs) AS BIGINT) AS Total_vcp,
      CAST(sum(TotalNumberofLooseSSP) AS BIGINT) AS Total_loose_ssp,
      CAST(sum(TotalNumberofSSPsintheDistro) AS BIGINT) AS Total_ssp,
      count(Distro) AS Total_distro, count(DISTINCT DPCI) AS Total_dpci,
      CAST(coalesce(sum(Total_locs), 0) AS BIGINT) AS Total_CandB_locs
      FROM rows_planned GROUP BY scenario_id, {KEYS}, wave_id)""",
    """summary AS (SELECT t.*, (t.Total_CandB_locs + c.pallet_size) / (c.practical_locations + 5) AS Aisle_utilz
      FROM totals t JOIN capacity c ON c.scenario_id = t.scenario_id)""",
]


def _query(steps: list[str], select: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n" + select


def _to_waves(scenarios: list[Scenario]) -> list[str]:
    return [*TO_RUNNING, *_scenarios(scenarios), *WAVES]


def _to_plan(scenarios: list[Scenario]) -> list[str]:
    return [*_to_waves(scenarios), *PALLETS, *PLACED]


def _domain(name: str, source: str) -> str:
    return f"SELECT DISTINCT '{name}' AS domain, CAST({name} AS VARCHAR) AS value FROM {source}"


_FAULTY = f"faulty AS ({select_text(FAULTY_COLUMNS)})"
_REASONS = [
    _FAULTY,
    """first_check AS (SELECT * REPLACE (CASE WHEN isnan(VCPWidth) THEN NULL ELSE VCPWidth END AS VCPWidth) FROM faulty)""",
    """second_check AS (SELECT *, CASE WHEN drop_id IS NULL OR Distro IS NULL OR SSZ IS NULL OR DPCI IS NULL
        OR UnitSortable IS NULL THEN 'missing_key'
      WHEN coalesce(SSPsinVCP, 0) <= 0 OR coalesce(TotalNumberofFullVCPs, -1) < 0
        OR coalesce(TotalNumberofLooseSSP, -1) < 0 OR coalesce(TotalNumberofPallets, -1) < 0 THEN 'bad_quantity'
      WHEN coalesce(VCPHeight, 0) <= 0 OR coalesce(VCPWidth, 0) <= 0 OR coalesce(VCPLength, 0) <= 0 THEN 'bad_dimension'
      END AS own_reason FROM first_check)""",
    """checked AS (SELECT *, coalesce(own_reason, CASE WHEN count(*) FILTER (WHERE own_reason IS NULL)
      OVER (PARTITION BY drop_id, Distro, SSZ, DPCI) > 1 THEN 'duplicate_key' END) AS reject_reason FROM second_check)""",
]

_SWEEP = [
    *TO_RUNNING,
    *_scenarios(all_scenarios()),
    f"""zones AS (SELECT Method, {KEYS}, max(wave_cum_locations) AS zone_locations FROM running GROUP BY Method, {KEYS})""",
    """sized_waves AS (SELECT z.*, c.carton_size, CAST(ceil(z.zone_locations / c.carton_size) AS BIGINT) AS n_waves
      FROM zones z JOIN (SELECT DISTINCT Method, carton_size FROM capacity) c ON c.Method = z.Method)""",
    f"""filled AS (SELECT s.Method, s.drop_id, s.UnitSortable, s.SSZ, s.zone_locations, s.carton_size, s.n_waves,
      CAST(coalesce(sum(r.Total_locs) FILTER (WHERE ceil(r.wave_cum_locations / s.carton_size) = s.n_waves), 0) AS BIGINT)
        AS last_wave_fill
      FROM sized_waves s JOIN running r ON r.Method = s.Method AND {_SAME_ZONE.format(a='r', b='s')}
      GROUP BY ALL)""",
    f"""sweep AS (SELECT f.drop_id, f.UnitSortable, f.SSZ, c.UDC, c.Aisle_No, c.Cap, c.Method, c.Level_A, f.carton_size,
      f.zone_locations, f.n_waves, f.last_wave_fill
      FROM filled f JOIN capacity c ON c.Method = f.Method AND c.carton_size = f.carton_size)""",
]

_DAYS = [day.isoformat(sep=" ") for day in DATES]
_ITEM_COLUMNS = f"{KEYS}, DPCI"
_FIT = "Loc_vcp_rmng, Loc_extra, Loc_tray, Loc_extra_tray, Loose_ssp_flag"
_GEOMETRY = "Loc_wt, Loc_lt, Loc_ht1, Loc_ht2, Loc_tot"

ORACLES: dict[str, str] = {
    "scan_drops": _query([DROPS], "SELECT * FROM drops"),
    "preview": _query(
        [DROPS], "SELECT * FROM drops ORDER BY drop_id, AllocationRequestDate, Aisle, Distro LIMIT 5"
    ),
    "distro_prep": _query(
        [DROPS],
        """SELECT drop_id, UnitSortable, Distro, DPCI, SSZ, TotalNumberofFullVCPs AS vcp, TotalNumberofLooseSSP AS ssp,
        TotalNumberofPallets AS pallet, SSPsinVCP AS ssp_q, VCPHeight, VCPWidth, VCPLength, Aisle AS wh_aisle FROM drops""",
    ),
    "filter_unit_sortable": _query([DROPS], "SELECT * FROM drops WHERE UnitSortable = 'Y'"),
    "non_pallet": _query([DROPS], "SELECT * FROM drops WHERE TotalNumberofPallets = 0"),
    "pallet_rows": _query([DROPS], "SELECT * FROM drops WHERE TotalNumberofPallets > 0"),
    "carton_rows": _query([DROPS], "SELECT * FROM drops WHERE TotalNumberofPallets = 0 AND SSZ = 9"),
    "filter_date_range": _query(
        [DROPS],
        f"""SELECT * FROM drops WHERE AllocationRequestDate >= TIMESTAMP '{_DAYS[0]}'
        AND AllocationRequestDate <= TIMESTAMP '{_DAYS[1]}'""",
    ),
    "domain_values": _query(
        [DROPS, *_scenarios([DEFAULT])],
        " UNION ALL ".join(
            _domain(name, source)
            for name, source in (("SSZ", "drops"), ("UnitSortable", "drops"), ("UDC", "aisles"), ("Aisle_No", "aisles"))
        ),
    ),
    "rejects": _query(
        _REASONS,
        """SELECT drop_id, Distro, DPCI, SSZ, UnitSortable, reject_reason FROM checked WHERE reject_reason IS NOT NULL""",
    ),
    "accepted_rows": _query(
        _REASONS, "SELECT * EXCLUDE (own_reason, reject_reason) FROM checked WHERE reject_reason IS NULL"
    ),
    "dims_canonical": _query([DROPS, *BY_ROW], "SELECT Distro, Ht, Wt, Lt FROM by_row"),
    "slot_geometry": _query([DROPS, *BY_ROW], f"SELECT Distro, {_GEOMETRY} FROM by_row"),
    "distro_locations": _query(
        [DROPS, *BY_ROW], f"SELECT Distro, SSZ, DPCI, Ratio, {_FIT}, locs AS Total_locs FROM by_row"
    ),
    "dpci_rollup": _query([DROPS, ROLLUP], "SELECT * FROM rollup_items"),
    "dpci_locations": _query(
        [DROPS, *BY_ITEM],
        f"SELECT {_ITEM_COLUMNS}, vcp, Ratio, Ht, Wt, Lt, {_GEOMETRY}, {_FIT}, locs AS Total_locs FROM by_item",
    ),
    "dpci_locs_joined": _query(
        [DROPS, *BY_ITEM],
        f"""SELECT d.Distro, d.drop_id, d.UnitSortable, d.SSZ, d.DPCI, i.locs AS Total_locs FROM drops d
        LEFT JOIN by_item i ON {_SAME_ZONE.format(a='i', b='d')} AND i.DPCI = d.DPCI WHERE d.TotalNumberofPallets = 0""",
    ),
    "dpci_first_distro": _query(
        [DROPS, *BY_ITEM, MASKED], f"SELECT Distro, {_ITEM_COLUMNS}, rank, locs AS Total_locs FROM masked"
    ),
    "dpci_first_distro_by_zone": _query(
        [DROPS, *BY_ITEM, _masked("masked", _ITEM_COLUMNS).replace("d.*, d.rank,", "d.*,")],
        f"SELECT Distro, {_ITEM_COLUMNS}, rank, locs AS Total_locs FROM masked",
    ),
    "method_select": _query(TO_RUNNING, f"SELECT Method, Distro, {_ITEM_COLUMNS}, Total_locs FROM sized"),
    "capacity_lookup": _query(
        [*TO_RUNNING, *_scenarios(LOOKUPS)],
        f"""SELECT z.*, c.* EXCLUDE (Method) FROM (SELECT Method, {KEYS}, CAST(sum(Total_locs) AS BIGINT) AS zone_locations
        FROM sized GROUP BY Method, {KEYS}) z JOIN capacity c ON c.Method = z.Method""",
    ),
    "carton_running": _query(
        TO_RUNNING, f"SELECT Distro, {KEYS}, Total_locs, wave_cum_locations FROM running WHERE Method = 'Distro'"
    ),
    "carton_running_scaled": _query(
        TO_RUNNING, f"SELECT Distro, {KEYS}, Total_locs, wave_cum_locations FROM running WHERE Method = 'Distro'"
    ),
    "carton_waves": _query(
        _to_waves(SCENARIOS),
        f"SELECT scenario_id, Distro, {KEYS}, Total_locs, wave_no, 'W' || wave_no AS wave_id FROM waves",
    ),
    "last_wave_fill": _query(_to_waves(SCENARIOS), f"SELECT scenario_id, {KEYS}, last_wave, last_fill FROM last_waves"),
    "pallet_rollup": _query([DROPS, PALLET_ITEMS], "SELECT * FROM pallet_items"),
    "pallet_waves": _query(
        [DROPS, *_scenarios([DEFAULT]), *PALLETS],
        f"""SELECT {_ITEM_COLUMNS}, pallets, vcp, VCPHt, pallet_loc, pallet_cum_locations, wave_no, 'W' || wave_no AS wave_id
        FROM pallet_waves""",
    ),
    "wave_limits": _query(
        [*_to_waves([DEFAULT]), *PALLETS],
        f"""SELECT coalesce(n.drop_id, p.drop_id) AS drop_id, coalesce(n.UnitSortable, p.UnitSortable) AS UnitSortable,
        coalesce(n.SSZ, p.SSZ) AS SSZ, coalesce(n.scenario_id, p.scenario_id) AS scenario_id,
        n.last_wave AS last_carton_wave, p.last_pallet_wave FROM last_no n
        FULL JOIN (SELECT scenario_id, {KEYS}, max(wave_no) AS last_pallet_wave FROM pallet_waves GROUP BY scenario_id, {KEYS}) p
        ON n.scenario_id = p.scenario_id AND {_SAME_ZONE.format(a='n', b='p')}""",
    ),
    "pallet_split": _query(
        _to_plan(SCENARIOS),
        f"SELECT scenario_id, Distro, {KEYS}, pallet_wave_no, last_wave, placement FROM pallet_placed",
    ),
    "pallet_trailing_policy": _query(
        _to_plan(SCENARIOS),
        f"""SELECT scenario_id, {KEYS}, placement, max(trailing_pallets) AS trailing_pallets, count(*) AS "rows"
        FROM pallet_placed WHERE placement <> 'kept' GROUP BY scenario_id, {KEYS}, placement""",
    ),
    "pallet_trailing_small": _query(
        _to_plan(SCENARIOS),
        f"""SELECT f.scenario_id, f.Distro, f.drop_id, f.UnitSortable, f.SSZ, f.Aisle, f.Total_locs, p.wave_id FROM few f
        JOIN plan p ON p.scenario_id = f.scenario_id AND p.Distro = f.Distro""",
    ),
    "charging_instructions": _query(
        [DROPS],
        """SELECT Distro, VCPHeight, CASE WHEN VCPHeight > 15 THEN 'Charge to Top Level' ELSE 'Level A & B' END
        AS "Charging Instructions" FROM drops""",
    ),
    "date_texts": _query(
        [DROPS],
        """SELECT Distro, CASE WHEN Aisle % 8 < 6 THEN CAST(AllocationRequestDate AS TIMESTAMP) END AS AllocationRequestDate,
        Aisle % 8 = 6 AS bad_date FROM drops""",
    ),
    "assigned": _query(
        _to_plan(SCENARIOS),
        f"""SELECT scenario_id, Distro, {_ITEM_COLUMNS}, Total_locs, wave_id, "Charging Instructions" FROM rows_planned""",
    ),
    "assigned_in_parts": _query(
        _to_plan(SCENARIOS[:2]),
        f"""SELECT scenario_id, Distro, {_ITEM_COLUMNS}, Total_locs, wave_id, "Charging Instructions" FROM rows_planned""",
    ),
    "pallet_zones": _query(
        [f"drops AS ({select_text(STACKED_COLUMNS)})", *_to_plan(SCENARIOS[:3])[1:]],
        f"SELECT scenario_id, Distro, {_ITEM_COLUMNS}, TotalNumberofPallets, Total_locs, wave_id FROM rows_planned",
    ),
    "wave_summary_in_parts": _query([*_to_plan(SCENARIOS[:2]), *SUMMARY], "SELECT * FROM summary"),
    "export_assigned": _query(_to_plan([DEFAULT]), "SELECT * EXCLUDE (scenario_id) FROM rows_planned"),
    "wave_summary": _query([*_to_plan([DEFAULT]), *SUMMARY], "SELECT * FROM summary"),
    "wave_summary_scenarios": _query([*_to_plan(SCENARIOS), *SUMMARY], "SELECT * FROM summary"),
    "wave_utilisation": _query(
        [*_to_plan(SCENARIOS[:2]), *SUMMARY],
        f"""SELECT scenario_id, {KEYS}, wave_id, Total_CandB_locs, Aisle_utilz,
        format('{{:.2f}}%', Aisle_utilz * 100) AS Aisle_utilz_text FROM summary""",
    ),
    "scenario_sweep": _query(_SWEEP, "SELECT * FROM sweep"),
    "scenario_best": _query(
        _SWEEP,
        f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
        PARTITION BY {KEYS}, UDC, Cap, Method, Level_A
        ORDER BY n_waves, last_wave_fill / carton_size DESC, Aisle_No) AS place FROM sweep) WHERE place = 1""",
    ),
}
