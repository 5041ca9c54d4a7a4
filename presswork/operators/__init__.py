"""Operators: canonical DataFrames in, one lazy DataFrame out.

``limit`` cuts a report to its first rows; ``None`` returns all of them.
"""

from presswork.operators.changeover import (
    mold_change_kpi, mold_change_kpi_summary, mold_change_quality, mold_change_trend, mold_changes,
)
from presswork.operators.energy import (
    energy_alert_rollup, energy_alerts, energy_live, energy_live_summary, energy_stops,
)
from presswork.operators.inventory import table_row_counts
from presswork.operators.losses import downtime_log, downtime_pareto, scrap_pareto
from presswork.operators.materials import (
    material_daily_trend, material_summary, material_totals, material_use_by_order,
    materials_list, planned_material_need,
)
from presswork.operators.options import (
    filter_articles, filter_machines, filter_molds, filter_shifts, filter_workshops,
)
from presswork.operators.orders import sap_orders
from presswork.operators.production import machine_kpi, machine_kpi_summary, mold_kpi
from presswork.operators.skills import iluo_matrix, iluo_pivot, operator_list, operator_time

__all__ = [
    "downtime_log", "downtime_pareto", "energy_alert_rollup", "energy_alerts", "energy_live",
    "energy_live_summary", "energy_stops", "filter_articles", "filter_machines", "filter_molds",
    "filter_shifts", "filter_workshops", "iluo_matrix", "iluo_pivot", "machine_kpi",
    "machine_kpi_summary",
    "material_daily_trend", "material_summary", "material_totals", "material_use_by_order",
    "materials_list", "mold_change_kpi", "mold_change_kpi_summary", "mold_change_quality",
    "mold_change_trend", "mold_changes", "mold_kpi", "operator_list", "operator_time",
    "planned_material_need", "sap_orders", "scrap_pareto", "table_row_counts",
]
