"""DuckDB SQL for every registered query, written apart from the operators.

Only the bindings of the canonical tables are shared; they stand in front of
each statement as common table expressions.
"""

from __future__ import annotations

import re

from presswork.sources.bindings import BINDINGS, SOURCES, bound_sql


def _round(value: str, places: int = 2) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,6)), {places}) AS DOUBLE)"


def _pct(part: str, whole: str) -> str:
    return _round(f"CASE WHEN COALESCE({whole}, 0) = 0 THEN 0e0 "
                  f"ELSE CAST({part} AS DOUBLE) / {whole} * 100.0e0 END")


def _order(first: str, columns: str) -> str:
    """ORDER BY ``first``, then every one of ``columns``."""
    rest = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in columns.split(","))
    return f"ORDER BY {first}, {rest}"


def _limit(limit: int | None) -> str:
    return "" if limit is None else f"LIMIT {limit}"


def _days(column: str, first: str, last: str) -> str:
    return f"CAST({column} AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'"


RUN_DAYS = _days("shift_start", "1997-01-01", "1999-12-31")
WORKSHOP = "workshop = 'NATION_3'"
RUNS_FILTER = f"{RUN_DAYS} AND shift = 'A' AND {WORKSHOP}"
MOLDS = "mold_code IN ('Brand#2', 'Brand#7', 'Brand#11')"
EVENT_DAYS = ("2024-01-05", "2024-01-20")


# --- choices for the filter fields ---

def _choices(code: str, label: str, where: str = "TRUE") -> str:
    return f"""SELECT DISTINCT {code}, COALESCE({label}, {code}) AS {label}
        FROM production_results WHERE TRIM({code}) <> '' AND {where}"""


def _codes(table: str, code: str) -> str:
    return f"SELECT DISTINCT {code} FROM {table} WHERE TRIM({code}) <> ''"


# --- production ---

_SUMS = f"""CAST(SUM(COALESCE(qty_made, 0)) AS BIGINT) AS pieces,
    CAST(SUM(COALESCE(qty_scrap, 0)) AS BIGINT) AS scrap_pieces,
    {_pct("SUM(COALESCE(qty_scrap, 0))", "SUM(COALESCE(qty_made, 0))")} AS scrap_pct"""
_OEE = _pct("SUM(COALESCE(time_useful, 0))", "SUM(COALESCE(time_open, 0))") + " AS oee_pct"


def _machine_kpi(where: str = "TRUE", limit: int | None = 100) -> str:
    rates = ", ".join(
        _round(f"AVG(COALESCE({rate}, 0)) * 100.0e0") + f" AS {rate}_pct"
        for rate in ("availability", "performance", "quality"))
    return f"""SELECT machine_code, COALESCE(machine_name, machine_code) AS machine_name,
            {_SUMS}, {rates}, {_OEE}
        FROM (SELECT * FROM production_results WHERE {where}) r
        GROUP BY r.machine_code, r.machine_name
        {_order("pieces DESC", "1, 2")} {_limit(limit)}"""


def _machine_kpi_summary(limit: int | None = None) -> str:
    return f"""SELECT 'CELKEM' AS machine_code, 'Souhrn za výběr' AS machine_name,
            CAST(SUM(pieces) AS BIGINT) AS pieces,
            CAST(SUM(scrap_pieces) AS BIGINT) AS scrap_pieces,
            {_pct("SUM(scrap_pieces)", "SUM(pieces)")} AS scrap_pct,
            {_round("CASE WHEN SUM(pieces) > 0 THEN SUM(oee_pct * pieces) / SUM(pieces) "
                    "ELSE AVG(oee_pct) END")} AS oee_pct
        FROM ({_machine_kpi(limit=limit)}) HAVING COUNT(*) > 0"""


def _mold_kpi(where: str = "TRUE", limit: int | None = 30) -> str:
    return f"""SELECT COALESCE(mold_code, 'Nespecifikováno') AS mold_code,
            COALESCE(mold_name, mold_code) AS mold_name, {_SUMS}, {_OEE}
        FROM (SELECT * FROM production_results WHERE {where}) r
        GROUP BY r.mold_code, r.mold_name
        {_order("pieces DESC", "1, 2")} {_limit(limit)}"""


# --- losses ---

def _machines_where(condition: str) -> str:
    return f"machine_code IN (SELECT machine_code FROM production_results WHERE {condition})"


def _downtime_pareto(
    where: str = "TRUE", limit: int | None = 15, share_of: str = "causes"
) -> str:
    return f"""WITH causes AS (
            SELECT COALESCE(NULLIF(TRIM(reason_label), ''), reason_code) AS reason,
                {_round("SUM(duration_s) / 3600.0e0")} AS hours, COUNT(*) AS stops
            FROM downtimes WHERE duration_s > 0 AND {where}
            GROUP BY reason_label, reason_code
            {_order("SUM(duration_s) DESC", "1, 3")}),
        shown AS (SELECT * FROM causes {_limit(limit)})
        SELECT reason, hours, stops, hours AS available_h,
            {_pct("hours", f"(SELECT SUM(hours) FROM {share_of})")} AS share_pct FROM shown"""


def _scrap_pareto(
    where: str = "TRUE", limit: int | None = 15, share_of: str = "causes"
) -> str:
    return f"""WITH causes AS (
            SELECT COALESCE(NULLIF(TRIM(defect_label), ''), defect_code) AS defect,
                CAST(SUM(qty) AS BIGINT) AS pieces
            FROM scraps WHERE qty > 0 AND {where}
            GROUP BY defect_label, defect_code
            {_order("2 DESC", "1")}),
        shown AS (SELECT * FROM causes {_limit(limit)})
        SELECT defect, pieces,
            {_pct("pieces", f"(SELECT SUM(pieces) FROM {share_of})")} AS share_pct FROM shown"""


def _downtime_log(limit: int | None = 100) -> str:
    return f"""SELECT o.order_code, d.start_ts, d.end_ts, d.duration_s, r.reason
        FROM downtimes d LEFT JOIN downtime_orders o ON d.order_id = o.id
        LEFT JOIN downtime_reasons r ON d.reason_id = r.id
        {_order("d.start_ts DESC NULLS LAST",
                "d.end_ts, d.duration_s, d.order_id, d.reason_id, o.order_code, r.reason")}
        {_limit(limit)}"""


# --- energy ---

def _energy_alerts(where: str = "TRUE", limit: int | None = 5000) -> str:
    return f"""SELECT shift_start, shift_end, machine_code, shift, order_type, event_type,
            alert_start, alert_end, {_round("COALESCE(kwh, 0)")} AS kwh
        FROM energy_alerts WHERE {where}
        {_order("shift_start DESC", "2, 3, 4, 5, 6, 7, 8, 9")} {_limit(limit)}"""


def _energy_alert_rollup(where: str = "TRUE", limit: int | None = None) -> str:
    return f"""SELECT COALESCE(NULLIF(TRIM(machine_code), ''), 'Neznámý lis') AS machine_code,
            COUNT(*) AS alerts,
            {_round("SUM(CASE WHEN alert_end > alert_start THEN "
                    "(EPOCH_US(alert_end) - EPOCH_US(alert_start)) / 3.6e9 ELSE 0e0 END)")}
            AS hours,
            {_round("SUM(kwh)")} AS kwh
        FROM ({_energy_alerts(where, limit)}) GROUP BY 1"""


def _energy_live() -> str:
    return f"""SELECT machine_code, reading_ts, {_round("kw")} AS kw FROM energy_readings
        WHERE reading_ts = (SELECT MAX(reading_ts) FROM energy_readings)"""


def _energy_live_summary() -> str:
    return f"""SELECT MAX(reading_ts) AS reading_ts, {_round("COALESCE(SUM(kw), 0)")} AS total_kw,
            COUNT(*) FILTER (WHERE kw > 1.0) AS active_machines, COUNT(*) AS machines
        FROM ({_energy_live()})"""


def _energy_power(where: str = "TRUE") -> str:
    return f"""SELECT DATE_TRUNC('minute', reading_ts) AS minute,
            {_round("COALESCE(SUM(kw), 0)")} AS total_kw,
            COUNT(*) FILTER (WHERE kw > 1.0) AS active_machines, COUNT(*) AS machines
        FROM power_readings WHERE {where} GROUP BY 1"""


_CLOSED = """DATE_TRUNC('minute', reading_ts) + INTERVAL '1' MINUTE
    <= (SELECT MAX(reading_ts) - INTERVAL '10' MINUTE FROM power_readings)"""


def _energy_stops(where: str = "TRUE", limit: int | None = 50) -> str:
    return f"""SELECT machine_code, stop_code, stop_start, stop_end, {_round("kwh")} AS kwh
        FROM energy_stops e WHERE kwh > 0 AND {where}
        {_order("e.kwh DESC", "1, 2, 3, 4")} {_limit(limit)}"""


# --- skills ---

def _operator_time(where: str = "TRUE") -> str:
    return f"""SELECT operator_code, machine_code, CAST(SUM(duration_s) AS BIGINT) AS seconds
        FROM operator_log WHERE operator_code IS NOT NULL AND duration_s > 0 AND {where}
        GROUP BY operator_code, machine_code"""


_WORK = ("click", "error", "purchase", "signup", "view")


def _pivot(show: str, body: str) -> str:
    cells = ", ".join(f"MAX({show}) FILTER (WHERE machine_code = '{m}') AS {m}" for m in _WORK)
    return f"SELECT operator_code, {cells} FROM ({body}) GROUP BY operator_code"


def _iluo(low: int, middle: int, high: int, where: str = "TRUE", worked: str = "TRUE") -> str:
    return f"""SELECT *, {_round("seconds / 3600.0e0", 1)} AS hours,
            CASE WHEN seconds < {low} THEN 'I' WHEN seconds < {middle} THEN 'L'
                 WHEN seconds < {high} THEN 'U' ELSE 'O' END AS level
        FROM ({_operator_time(worked)}) WHERE {where}"""


# --- orders ---

def _sap_orders(where: str = "TRUE", limit: int | None = 100) -> str:
    return f"""SELECT h.order_code, COALESCE(machine_code, '-') AS machine_code,
            COALESCE(machine_name, machine_code) AS machine_name,
            COALESCE(mold_code, '-') AS mold_code, COALESCE(mold_name, mold_code) AS mold_name,
            COALESCE(strokes, 0) AS strokes, COALESCE(planned, 0) AS planned_pieces,
            COALESCE(good, 0) AS good_pieces, COALESCE(scrap, 0) AS scrap_pieces,
            {_round('''CASE WHEN COALESCE(planned, 0) <> 0 THEN good / CAST(planned AS DOUBLE) * 100.0e0
                WHEN COALESCE(strokes, 0) = 0 THEN 0e0
                ELSE COALESCE(good, 0) / CAST(strokes AS DOUBLE) * 100.0e0 END''', 1)}
            AS progress_pct,
            CASE UPPER(COALESCE(status_code, 'D')) WHEN 'L' THEN 'Běží' WHEN 'D' THEN 'Naplánováno'
                WHEN 'S' THEN 'Dokončeno' WHEN 'T' THEN 'Dokončeno'
                ELSE UPPER(status_code) END AS status,
            UPPER(COALESCE(status_code, 'D')) AS status_code,
            UPPER(COALESCE(status_code, 'D')) = 'L' AS is_active, actual_start, planned_start
        FROM order_headers h LEFT JOIN (
            SELECT order_code, MAX(product_code) AS product_code,
                CAST(SUM(COALESCE(qty_planned, 0)) AS BIGINT) AS planned,
                CAST(SUM(COALESCE(qty_good, 0)) AS BIGINT) AS good,
                CAST(SUM(COALESCE(qty_scrap, 0)) AS BIGINT) AS scrap
            FROM order_lines GROUP BY order_code) l ON h.order_code = l.order_code
        WHERE {where}
        {_order("CASE h.status_code WHEN 'L' THEN 0 WHEN 'D' THEN 1 ELSE 2 END, "
                "h.seq_no DESC NULLS LAST", "h.order_code")} {_limit(limit)}"""


# --- mold changes ---

def _timed_changes(where: str = "TRUE", seen: str = "TRUE") -> str:
    return f"""SELECT c.*, COALESCE(stop_end, shift_start) AS new_start,
            CASE WHEN stop_end IS NULL THEN 'DEBEQU' ELSE 'PROSTOJ' END AS time_source,
            DATE_DIFF('minute', old_end, COALESCE(stop_end, shift_start)) AS minutes
        FROM (
            SELECT c.*, (
                SELECT MAX(start_ts + INTERVAL '1' SECOND * duration_s) FROM downtimes d
                WHERE d.machine_code = c.machine_code AND d.duration_s > 0
                  AND d.start_ts >= c.old_end - INTERVAL '30' MINUTE
                  AND d.start_ts + INTERVAL '1' SECOND * duration_s
                      <= c.old_end + INTERVAL '16' HOUR) AS stop_end
            FROM (
                SELECT machine_code, LAG(mold_code) OVER w AS old_mold, mold_code AS new_mold,
                    COALESCE(product_code, '') AS product_code,
                    LAG(shift_end) OVER w AS old_end, shift_start
                FROM production_runs
                WHERE machine_code IS NOT NULL AND mold_code IS NOT NULL AND {where}
                WINDOW w AS (PARTITION BY machine_code ORDER BY shift_start NULLS FIRST,
                    shift_end NULLS FIRST, mold_code, product_code NULLS FIRST)) c
            WHERE old_mold <> new_mold AND old_end IS NOT NULL AND {seen}) c
        WHERE DATE_DIFF('minute', old_end, COALESCE(stop_end, shift_start)) BETWEEN 1 AND 480"""


def _mold_changes(where: str = "TRUE", limit: int | None = 500, seen: str = "TRUE") -> str:
    columns = "machine_code, old_mold, new_mold, product_code, old_end, new_start, " \
              "time_source, minutes"
    return f"""SELECT {columns} FROM ({_timed_changes(where, seen)})
        {_order("old_end DESC", columns)} {_limit(limit)}"""


def _mold_change_quality(limit: int | None = None) -> str:
    return f"""SELECT COUNT(*) AS changes,
            COUNT(*) FILTER (WHERE time_source = 'PROSTOJ') AS precise_changes,
            COUNT(*) FILTER (WHERE time_source = 'DEBEQU') AS estimated_changes
        FROM ({_mold_changes(limit=limit)})"""


def _mold_change_trend(where: str = "TRUE") -> str:
    return f"""SELECT CAST(old_end AS DATE) AS day, COUNT(*) AS changes,
            {_round("AVG(minutes)", 1)} AS avg_min
        FROM ({_timed_changes(where)}) GROUP BY 1"""


def _mold_change_kpi(where: str = "TRUE") -> str:
    return f"""SELECT machine_code, COUNT(*) AS changes,
            COUNT(*) FILTER (WHERE time_source = 'PROSTOJ') AS precise_changes,
            {_round("AVG(minutes)", 1)} AS avg_min, CAST(MIN(minutes) AS DOUBLE) AS min_min,
            CAST(MAX(minutes) AS DOUBLE) AS max_min,
            {_round("STDDEV_SAMP(minutes)", 1)} AS stddev_min
        FROM ({_timed_changes(where)}) GROUP BY machine_code"""


# --- materials ---

_SPENT = "qty_per_piece * CASE WHEN recyclable = 0 THEN COALESCE(qty_made, 0) " \
         "ELSE COALESCE(qty_good, 0) END"
_USED_BOM = """production_results r JOIN bom b
    ON r.product_code = b.product_code AND r.bom_revision = b.bom_revision"""
_WITH_TEXTS = f"{_USED_BOM} JOIN consumables c ON b.material_code = c.material_code"
_MADE = "TRIM(r.order_code) <> '' AND TRIM(r.product_code) <> ''"


def _materials_list() -> str:
    return """SELECT material_code, COALESCE(material_name, material_code) AS material_name,
            COALESCE(unit, 'KG') AS unit, COALESCE(type_label, 'Ostatní') AS type
        FROM consumables c LEFT JOIN consumable_types t ON c.type_code = t.type_code
        WHERE EXISTS (SELECT 1 FROM bom b WHERE b.material_code = c.material_code)"""


def _planned(where: str = "TRUE", limit: int | None = 500) -> str:
    def kilos(pieces: str) -> str:
        return _round(f"qty_per_piece * {pieces}")
    return f"""WITH needs AS (
            SELECT h.order_code, l.product_code, b.material_code,
                COALESCE(qty_planned, 0) AS planned_pieces, COALESCE(qty_good, 0) AS good_pieces,
                COALESCE(qty_scrap, 0) AS scrap_pieces,
                CASE WHEN COALESCE(qty_planned, 0) > COALESCE(qty_good, 0)
                     THEN COALESCE(qty_planned, 0) - COALESCE(qty_good, 0)
                     ELSE 0 END AS remaining_pieces,
                qty_per_piece, machine_code, machine_name, mold_code, h.status_code,
                material_name, unit, product_name, status_label
            FROM order_headers h JOIN order_lines l ON h.order_code = l.order_code
            LEFT JOIN products p ON l.product_code = p.product_code
            JOIN bom b ON l.product_code = b.product_code AND l.bom_revision = b.bom_revision
            JOIN consumables c ON b.material_code = c.material_code
            LEFT JOIN order_status s ON h.status_code = s.status_code
            WHERE h.status_code IN ('L', 'D', 'P', 'S') AND TRIM(h.order_code) <> ''
              AND TRIM(l.product_code) <> '' AND {where})
        SELECT order_code, COALESCE(machine_code, '-') AS machine_code,
            COALESCE(machine_name, machine_code) AS machine_name,
            COALESCE(mold_code, '-') AS mold_code, product_code,
            COALESCE(product_name, product_code) AS product_name, material_code,
            COALESCE(material_name, material_code) AS material_name, COALESCE(unit, 'KG') AS unit,
            {_round("qty_per_piece", 4)} AS dose, planned_pieces, good_pieces, scrap_pieces,
            remaining_pieces, {kilos("planned_pieces")} AS planned_kg,
            {kilos("good_pieces")} AS used_kg, {kilos("remaining_pieces")} AS needed_kg,
            status_code, COALESCE(status_label, status_code) AS status
        FROM needs n
        {_order("needed_kg DESC", "n.order_code, n.product_code, n.material_code, "
                "n.planned_pieces, n.good_pieces, n.scrap_pieces, n.remaining_pieces, "
                "n.qty_per_piece, n.machine_code, n.machine_name, n.mold_code, n.status_code, "
                "n.material_name, n.unit, n.product_name, n.status_label")} {_limit(limit)}"""


def _by_order(where: str = "TRUE", limit: int | None = 500) -> str:
    keys = "r.order_code, r.machine_code, r.machine_name, r.product_code, r.product_name, " \
           "b.material_code, c.material_name, c.unit"

    def kilos(pieces: str) -> str:
        return _round(f"SUM(qty_per_piece * COALESCE({pieces}, 0))")

    def pieces(column: str) -> str:
        return f"CAST(SUM(COALESCE({column}, 0)) AS BIGINT)"
    return f"""SELECT r.order_code, r.machine_code,
            COALESCE(r.machine_name, r.machine_code) AS machine_name, r.product_code,
            COALESCE(r.product_name, r.product_code) AS product_name, b.material_code,
            COALESCE(c.material_name, b.material_code) AS material_name,
            COALESCE(c.unit, 'KG') AS unit, {_round("AVG(qty_per_piece)", 4)} AS dose,
            {pieces("qty_made")} AS pieces, {pieces("qty_good")} AS good_pieces,
            {pieces("qty_scrap")} AS scrap_pieces, {_round(f"SUM({_SPENT})")} AS total_kg,
            {kilos("qty_good")} AS good_kg, {kilos("qty_scrap")} AS scrap_kg,
            MIN(shift_start) AS first_start, MAX(shift_end) AS last_end
        FROM {_WITH_TEXTS} WHERE {_MADE} AND {where}
        GROUP BY {keys} HAVING SUM(COALESCE(qty_made, 0)) > 0
        {_order("total_kg DESC", keys)} {_limit(limit)}"""


def _trend(where: str = "TRUE") -> str:
    return f"""SELECT CAST(shift_start AS DATE) AS day, {_round(f"SUM({_SPENT})")} AS total_kg,
            CAST(SUM(COALESCE(qty_made, 0)) AS BIGINT) AS pieces,
            COUNT(DISTINCT r.order_code) AS orders
        FROM {_USED_BOM} WHERE {_MADE} AND {where} GROUP BY 1"""


def _materials(where: str = "TRUE", limit: int | None = 50) -> str:
    keys = "b.material_code, c.material_name, c.unit"
    return f"""SELECT b.material_code, COALESCE(c.material_name, b.material_code) AS material_name,
            COALESCE(c.unit, 'KG') AS unit, COUNT(DISTINCT r.order_code) AS orders,
            COUNT(DISTINCT r.machine_code) AS machines, {_round(f"SUM({_SPENT})")} AS total_kg,
            {_round("SUM(qty_per_piece * COALESCE(qty_scrap, 0))")} AS scrap_kg
        FROM {_WITH_TEXTS} WHERE {_MADE} AND {where} GROUP BY {keys}
        {_order("total_kg DESC", keys)} {_limit(limit)}"""


def _totals(limit: int | None = None) -> str:
    def kilos(column: str) -> str:
        return f"{_round(f'COALESCE(SUM({column}), 0)')} AS {column}"
    return f"""WITH future AS ({_planned(limit=limit)}), past AS ({_by_order(limit=limit)})
        SELECT f.*, p.*, {_pct("p.scrap_kg", "p.total_kg")} AS scrap_share_pct FROM (
            SELECT {kilos("needed_kg")}, {kilos("planned_kg")}, {kilos("used_kg")},
                CAST(COALESCE(SUM(remaining_pieces), 0) AS BIGINT) AS remaining_pieces,
                COUNT(DISTINCT order_code) AS open_orders,
                COUNT(DISTINCT CASE WHEN machine_code <> '-' THEN machine_code END)
                AS open_machines FROM future) f
        CROSS JOIN (
            SELECT {kilos("total_kg")}, {kilos("good_kg")}, {kilos("scrap_kg")},
                CAST(COALESCE(SUM(pieces), 0) AS BIGINT) AS pieces,
                COUNT(DISTINCT order_code) AS orders, COUNT(DISTINCT machine_code) AS machines
            FROM past) p"""


def _row_counts() -> str:
    tables = [name for name in BINDINGS if name not in ("production_runs", "power_readings")]
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {name}" for name in tables)
    return f"""SELECT * FROM ({counts}) WHERE row_count > 0
        ORDER BY row_count DESC, table_name LIMIT 20"""


_MACHINES = "machine_code IN ('3', '7', '11', '42')"
_ARTICLES = "product_code IN (" + ", ".join(f"'{n}'" for n in range(1, 60)) + ")"
_USE = f"{RUN_DAYS} AND shift = 'A' AND b.material_code = 'PROMO'"
_CLICK_VIEW = _days("shift_start", *EVENT_DAYS)

BODIES: dict[str, str] = {
    "filter_machines": _choices("machine_code", "machine_name"),
    "filter_shifts": _codes("production_results", "shift"),
    "filter_workshops": _codes("production_results", "workshop"),
    "filter_articles": _choices("product_code", "product_name"),
    "filter_molds": _choices("mold_code", "mold_name"),
    "machine_kpi": _machine_kpi(),
    "machine_kpi_summary": _machine_kpi_summary(),
    "mold_kpi": _mold_kpi(),
    "downtime_pareto": _downtime_pareto(),
    "scrap_pareto": _scrap_pareto(),
    "energy_alerts": _energy_alerts(),
    "energy_alert_rollup": _energy_alert_rollup(),
    "energy_live": _energy_live(),
    "energy_live_summary": _energy_live_summary(),
    "energy_stops": _energy_stops(),
    "operator_time": _operator_time(),
    "iluo_matrix": _iluo(144_000, 288_000, 1_728_000),
    "operator_list": _codes("operator_log", "operator_code"),
    "sap_orders": _sap_orders(),
    "downtime_log": _downtime_log(),
    "mold_changes": _mold_changes(),
    "mold_change_quality": _mold_change_quality(),
    "mold_change_kpi": _mold_change_kpi(),
    "mold_change_kpi_summary": f"""SELECT CAST(COALESCE(SUM(changes), 0) AS BIGINT) AS changes,
            COALESCE({_round("SUM(avg_min * changes) / SUM(changes)", 1)}, 0e0) AS avg_min
        FROM ({_mold_change_kpi()})""",
    "mold_change_trend": _mold_change_trend(),
    "materials_list": _materials_list(),
    "planned_material_need": _planned(),
    "material_use_by_order": _by_order(),
    "material_daily_trend": _trend(),
    "material_summary": _materials(),
    "material_totals": _totals(),
    "table_row_counts": _row_counts(),
    "filter_articles__narrowed": _choices(
        "product_code", "product_name", f"{WORKSHOP} AND {MOLDS}"),
    "filter_molds__narrowed": _choices("mold_code", "mold_name", WORKSHOP),
    "machine_kpi__all": _machine_kpi(limit=None),
    "machine_kpi__filtered": _machine_kpi(RUNS_FILTER),
    "machine_kpi__molds": _machine_kpi(MOLDS),
    "mold_kpi__filtered": _mold_kpi(RUNS_FILTER),
    "downtime_pareto__all": _downtime_pareto(limit=None),
    "downtime_pareto__filtered": _downtime_pareto(
        f"{_days('start_ts', *EVENT_DAYS)} AND shift = 'R' "
        f"AND {_machines_where(WORKSHOP)} "
        f"AND {_machines_where(MOLDS)}"),
    "scrap_pareto__all": _scrap_pareto(limit=None),
    "scrap_pareto__filtered": _scrap_pareto(
        f"{RUN_DAYS} AND shift = 'A' "
        f"AND {_machines_where(WORKSHOP)} "
        f"AND {_machines_where(MOLDS)}"),
    "energy_alerts__days": _energy_alerts(_days("shift_start", *EVENT_DAYS)),
    "energy_stops__all": _energy_stops(limit=None),
    "energy_stops__days": _energy_stops(_days("shift_start", *EVENT_DAYS)),
    "operator_time__filtered": _operator_time(
        f"{_days('shift_start', *EVENT_DAYS)} AND machine_code = 'click'"),
    "iluo_matrix__like": _iluo(100_000, 200_000, 900_000, "LOWER(operator_code) LIKE '%1%'"),
    "sap_orders__all": _sap_orders(limit=None),
    "sap_orders__days": _sap_orders(
        "mold_code IN ('Brand#2', 'Brand#7') AND (status_code = 'L' OR "
        + _days("COALESCE(actual_start, planned_start)", "1997-01-01", "1997-12-31") + ")", None),
    "downtime_log__all": _downtime_log(None),
    "mold_changes__all": _mold_changes(limit=None),
    "mold_changes__filtered": _mold_changes(
        f"{_CLICK_VIEW} AND mold_code IN ('click', 'view')", None),
    "mold_change_kpi__filtered": _mold_change_kpi(_CLICK_VIEW),
    "planned_material_need__all": _planned(limit=None),
    "planned_material_need__material": _planned("b.material_code = 'PROMO'"),
    "material_use_by_order__all": _by_order(limit=None),
    "material_use_by_order__filtered": _by_order(_USE),
    "material_daily_trend__filtered": _trend(_USE),
    "material_summary__filtered": _materials(RUNS_FILTER),
    "machine_kpi_summary__shown": _machine_kpi_summary(20),
    "energy_alert_rollup__shown": _energy_alert_rollup(limit=500),
    "mold_change_quality__shown": _mold_change_quality(100),
    "material_totals__shown": _totals(500),
    "downtime_pareto__shown": _downtime_pareto(share_of="shown"),
    "scrap_pareto__shown": _scrap_pareto(share_of="shown"),
    "machine_kpi__codes": _machine_kpi(f"{_MACHINES} AND {_ARTICLES}"),
    "mold_kpi__codes": _mold_kpi(f"{_MACHINES} AND {_ARTICLES}"),
    "mold_kpi__all": _mold_kpi(limit=None),
    "downtime_pareto__codes": _downtime_pareto(_MACHINES),
    "scrap_pareto__codes": _scrap_pareto(f"{_MACHINES} AND {_ARTICLES}"),
    "energy_alerts__codes": _energy_alerts(_MACHINES),
    "energy_alert_rollup__codes": _energy_alert_rollup(_MACHINES),
    "energy_alert_rollup__days": _energy_alert_rollup(_days("shift_start", *EVENT_DAYS)),
    "energy_stops__codes": _energy_stops(_MACHINES),
    "operator_time__operator": _operator_time("operator_code = '11'"),
    "sap_orders__codes": _sap_orders(f"{_MACHINES} AND {_ARTICLES}"),
    "sap_orders__machines": _sap_orders(_MACHINES),
    "mold_changes__codes": _mold_changes(_MACHINES),
    "mold_change_kpi__codes": _mold_change_kpi(_MACHINES),
    "mold_change_trend__codes": _mold_change_trend(_MACHINES),
    "mold_change_trend__days": _mold_change_trend(_CLICK_VIEW),
    "planned_material_need__codes": _planned(_MACHINES),
    "material_use_by_order__codes": _by_order(_MACHINES),
    "material_daily_trend__codes": _trend(_MACHINES),
    "material_summary__codes": _materials(_MACHINES),
    "material_summary__all": _materials(limit=None),
    "energy_power": _energy_power(),
    "energy_power__closed": _energy_power(_CLOSED),
    "energy_power__streamed": _energy_power(_CLOSED),
    "energy_live__stored": _energy_live(),
    "energy_alerts__stored": _energy_alerts(_days("shift_start", *EVENT_DAYS), 500),
    "downtime_log__stored": _downtime_log(),
    "mold_changes__detected_first": _mold_changes(
        limit=None, seen=f"{_CLICK_VIEW} AND new_mold IN ('click', 'view')"),
    "iluo_matrix__pivot": _pivot("level", _iluo(144_000, 288_000, 1_728_000)),
    "iluo_matrix__pivot_hours": _pivot("hours", _iluo(
        144_000, 288_000, 1_728_000, worked=_days("shift_start", *EVENT_DAYS))),
    "mold_changes__stored": _mold_changes(_CLICK_VIEW, None),
}


def _statement(body: str) -> str:
    """``body`` behind the canonical tables it mentions."""
    names = {name: name for name in SOURCES}
    tables = [
        f"{name} AS ({bound_sql(text, 'TIMESTAMP', **names)})"
        for name, text in BINDINGS.items() if re.search(rf"\b{name}\b", body)
    ]
    if body.startswith("WITH "):
        return f"WITH {', '.join(tables)}, {body.removeprefix('WITH ')}"
    return f"WITH {', '.join(tables)} {body}"


def statements() -> dict[str, str]:
    return {name: _statement(body) for name, body in BODIES.items()}
