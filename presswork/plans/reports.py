"""Reports that consist of several results, as one call over all tables.

Every function returns DataFrames by name. Lists are cut to the given limits;
totals, quality counts and shares cover all rows. By default each result is
computed from the tables on its own. With ``share=True`` what several results
are computed from is written once to the folder of ``spark.checkpoint.dir``,
which must be one that all executors share, and read from there.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from presswork import operators as ops
from presswork.filters import EVERYTHING, FilterSpec
from presswork.operators.materials import consumption_base
from presswork.plans.ranking import ranked
from presswork.sources.tables import Tables

Report = dict[str, DataFrame]


def _shared(df: DataFrame, share: bool) -> DataFrame:
    return df.checkpoint() if share else df


def filter_options(
    tables: Tables, spec: FilterSpec = EVERYTHING, share: bool = False
) -> Report:
    """The choices of all five fields; shared, from one list of the combinations in use."""
    results = tables.production_results
    if share:
        results = results.select(
            "machine_code", "machine_name", "shift", "workshop", "product_code", "product_name",
            "mold_code", "mold_name").distinct()
    results = _shared(results, share)
    return {
        "machines": ops.filter_machines(results),
        "shifts": ops.filter_shifts(results),
        "workshops": ops.filter_workshops(results),
        "articles": ops.filter_articles(results, spec),
        "molds": ops.filter_molds(results, spec),
    }


def machine_report(
    tables: Tables, spec: FilterSpec = EVERYTHING, limit: int | None = 100, share: bool = False
) -> Report:
    """Machines and the total of all machines."""
    machines = _shared(ops.machine_kpi(
        tables.production_results, spec, limit=None, ordered=False), share)
    return {
        "data": ranked(machines, F.desc("pieces"), limit=limit),
        "summary": ops.machine_kpi_summary(machines),
    }


def live_power_report(tables: Tables) -> Report:
    live = ops.energy_live(tables.energy_readings)
    return {"data": live, "summary": ops.energy_live_summary(live)}


def mold_change_report(
    tables: Tables, spec: FilterSpec = EVERYTHING, limit: int | None = 500, share: bool = False
) -> Report:
    """Changes and the quality of all changes."""
    changes = _shared(
        ops.mold_changes(
            tables.production_results, tables.downtimes, spec, limit=None, ordered=False), share)
    return {
        "data": ranked(changes, F.desc("old_end"), limit=limit),
        "quality": ops.mold_change_quality(changes),
    }


def _longest_first(kpi: DataFrame) -> DataFrame:
    return kpi.orderBy(F.desc("avg_min"), "machine_code")


def mold_change_kpi_report(
    tables: Tables, spec: FilterSpec = EVERYTHING, share: bool = False
) -> Report:
    kpi = _shared(ops.mold_change_kpi(
        tables.production_results, tables.downtimes, spec, ordered=False), share)
    return {"data": _longest_first(kpi), "summary": ops.mold_change_kpi_summary(kpi)}


def mold_change_overview(
    tables: Tables, spec: FilterSpec = EVERYTHING, limit: int | None = 500, share: bool = False
) -> Report:
    """Changes, their quality, durations per machine and their summary, and the trend.

    Shared, changes are found once; twice under a mold filter, which holds for
    the list and its quality only.
    """
    runs, stops = tables.production_results, tables.downtimes
    listed = _shared(ops.mold_changes(runs, stops, spec, limit=None, ordered=False), share)
    found = listed if spec.molds is None else _shared(
        ops.mold_changes(runs, stops, replace(spec, molds=None), limit=None, ordered=False), share)
    kpi = ops.mold_change_kpi(runs, stops, spec, changes=found, ordered=False)
    return {
        "data": ranked(listed, F.desc("old_end"), limit=limit),
        "quality": ops.mold_change_quality(listed),
        "kpi": _longest_first(kpi),
        "summary": ops.mold_change_kpi_summary(kpi),
        "trend": ops.mold_change_trend(runs, stops, spec, changes=found),
    }


def material_report(
    tables: Tables, spec: FilterSpec = EVERYTHING, planned_limit: int | None = 500,
    orders_limit: int | None = 500, materials_limit: int | None = 50, share: bool = False,
) -> Report:
    """Needs, consumption in three views and the totals of all orders.

    Shared, the runs are read once for all of them, into sums per day, order,
    machine and product, and the needs are computed once.
    """
    results, bom, consumables = tables.production_results, tables.bom, tables.consumables
    base = _shared(consumption_base(results, spec), share)
    planned = _shared(ops.planned_material_need(
        tables.order_headers, tables.order_lines, tables.products, bom, consumables,
        tables.order_status, spec, limit=None, ordered=False), share)
    by_order = _shared(ops.material_use_by_order(
        results, bom, consumables, spec, limit=None, base=base, ordered=False), share)
    keys = ("order_code", "product_code", "material_code", "planned_pieces", "good_pieces",
            "scrap_pieces", "remaining_pieces")
    return {
        "summary": ops.material_totals(planned, by_order),
        "planned_orders": ranked(
            planned, F.desc("needed_kg"), *map(F.col, keys), limit=planned_limit),
        "orders": ranked(by_order, F.desc("total_kg"), limit=orders_limit),
        "trend": ops.material_daily_trend(results, bom, spec, base=base),
        "materials_summary": ops.material_summary(
            results, bom, consumables, spec, materials_limit, base=base),
    }
