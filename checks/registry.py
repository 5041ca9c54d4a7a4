"""Every operator over the test tables, by name.

``name__all`` is a report without its row limit, ``name__filtered`` and the
like exercise the filters; the same filters stand in the SQL of
:mod:`checks.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork import FilterSpec
from presswork import operators as ops
from presswork.schemas import SCHEMAS
from presswork.sources.bindings import bound, bound_tables
from presswork.sources.store import Store, workspace
from presswork.sources.tables import Tables
from presswork.streaming.power import closed, keep_power, power_by_minute

Query = Callable[[SparkSession, str], DataFrame]

NO_FILTER = FilterSpec()
RUNS_FILTER = FilterSpec(start_date="1997-01-01", end_date="1999-12-31", shift="A",
                         workshop="NATION_3")
MOLD_FILTER = FilterSpec(molds=["Brand#2", "Brand#7", "Brand#11"])
EVENT_DAYS = FilterSpec(start_date="2024-01-05", end_date="2024-01-20")
EVENT_FILTER = FilterSpec(start_date="2024-01-05", end_date="2024-01-20", shift="R",
                          workshop="NATION_3", molds=["Brand#2", "Brand#7", "Brand#11"])
CLICK_VIEW = FilterSpec(start_date="2024-01-05", end_date="2024-01-20", molds=["click", "view"])
MATERIAL_FILTER = FilterSpec(material="PROMO")
USE_FILTER = FilterSpec(start_date="1997-01-01", end_date="1999-12-31", shift="A",
                        material="PROMO")


MACHINES = ("3", "7", "11", "42")
ARTICLES = tuple(str(n) for n in range(1, 60))
CODES = FilterSpec(machines=MACHINES, articles=ARTICLES)
MACHINES_ONLY = FilterSpec(machines=MACHINES)


def _results(spark, sf):
    return bound(spark, sf, "production_results")


def _machines(spark, sf, spec=NO_FILTER, limit=100, ordered=True):
    return ops.machine_kpi(_results(spark, sf), spec, limit, ordered)


def _molds(spark, sf, spec=NO_FILTER, limit=30):
    return ops.mold_kpi(_results(spark, sf), spec, limit)


def _downtimes(spark, sf, spec=NO_FILTER, limit=15, share_of="all"):
    return ops.downtime_pareto(
        bound(spark, sf, "downtimes"), _results(spark, sf), spec, limit, share_of)


def _scraps(spark, sf, spec=NO_FILTER, limit=15, share_of="all"):
    return ops.scrap_pareto(
        bound(spark, sf, "scraps"), _results(spark, sf), spec, limit, share_of)


def _alerts(operator, spark, sf, *args):
    return operator(bound(spark, sf, "energy_alerts"), *args)


def _downtime_log(spark, sf, limit=100):
    t = bound_tables(spark, sf)
    return ops.downtime_log(t.downtimes, t.downtime_orders, t.downtime_reasons, limit)


def _sap_orders(spark, sf, spec=NO_FILTER, limit=100):
    t = bound_tables(spark, sf)
    return ops.sap_orders(t.order_headers, t.order_lines, spec, limit)


def _changes(operator, spark, sf, *args):
    return operator(bound(spark, sf, "production_runs"), bound(spark, sf, "downtimes"), *args)


def _planned(spark, sf, spec=NO_FILTER, limit=500, ordered=True):
    t = bound_tables(spark, sf)
    return ops.planned_material_need(
        t.order_headers, t.order_lines, t.products, t.bom, t.consumables, t.order_status,
        spec, limit, ordered)


def _by_order(spark, sf, spec=NO_FILTER, limit=500, ordered=True):
    t = bound_tables(spark, sf)
    return ops.material_use_by_order(
        t.production_results, t.bom, t.consumables, spec, limit, ordered=ordered)


def _trend(spark, sf, spec=NO_FILTER):
    t = bound_tables(spark, sf)
    return ops.material_daily_trend(t.production_results, t.bom, spec)


def _materials(spark, sf, spec=NO_FILTER, limit=50):
    t = bound_tables(spark, sf)
    return ops.material_summary(t.production_results, t.bom, t.consumables, spec, limit)


def _materials_list(spark, sf):
    t = bound_tables(spark, sf)
    return ops.materials_list(t.consumables, t.consumable_types, t.bom)


def _operator_time(spark, sf, *args):
    return ops.operator_time(bound(spark, sf, "operator_log"), *args)


def _stored(spark, sf, *names) -> Tables:
    """Whole canonical tables written by day and machine, and read back."""
    store = Store(spark, workspace(spark), f"presswork_{uuid.uuid4().hex}", buckets=4)
    for name in names:
        df = bound(spark, sf, "production_runs" if name == "production_results" else name)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in SCHEMAS[name]
                   if f.name not in df.columns}
        store.write(name, df.withColumns(missing))
    return store.tables()


def _stored_changes(spark, sf):
    t = _stored(spark, sf, "production_results", "downtimes")
    return ops.mold_changes(t.production_results, t.downtimes, EVENT_DAYS, None)


def _stored_log(spark, sf):
    t = _stored(spark, sf, "downtimes", "downtime_orders", "downtime_reasons")
    return ops.downtime_log(t.downtimes, t.downtime_orders, t.downtime_reasons)


def _streamed_power(spark, sf):
    """All readings as a stream of files, and the minutes that it has appended when it ends."""
    root = workspace(spark)
    bound(spark, sf, "power_readings").write.parquet(f"{root}/readings")
    stream = spark.readStream.schema(SCHEMAS["energy_readings"]).parquet(f"{root}/readings")
    keep_power(stream, f"{root}/power", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/power").drop("minute_end")


def _closed_power(spark, sf):
    readings = bound(spark, sf, "power_readings")
    return closed(power_by_minute(readings), readings).drop("minute_end")


def _choices(operator, *spec):
    return lambda spark, sf: operator(_results(spark, sf), *spec)


# One per operator.
HEADLINE: dict[str, Query] = {
    "filter_machines": _choices(ops.filter_machines),
    "filter_shifts": _choices(ops.filter_shifts),
    "filter_workshops": _choices(ops.filter_workshops),
    "filter_articles": _choices(ops.filter_articles),
    "filter_molds": _choices(ops.filter_molds),
    "machine_kpi": _machines,
    "machine_kpi_summary": lambda s, sf: ops.machine_kpi_summary(
        _machines(s, sf, limit=None, ordered=False)),
    "mold_kpi": _molds,
    "downtime_pareto": _downtimes,
    "scrap_pareto": _scraps,
    "energy_alerts": lambda s, sf: _alerts(ops.energy_alerts, s, sf),
    "energy_alert_rollup": lambda s, sf: _alerts(
        ops.energy_alert_rollup, s, sf, NO_FILTER, None, False),
    "energy_live": lambda s, sf: ops.energy_live(bound(s, sf, "energy_readings")),
    "energy_live_summary": lambda s, sf: ops.energy_live_summary(
        ops.energy_live(bound(s, sf, "energy_readings"))),
    "energy_stops": lambda s, sf: ops.energy_stops(bound(s, sf, "energy_stops")),
    "operator_time": _operator_time,
    "iluo_matrix": lambda s, sf: ops.iluo_matrix(_operator_time(s, sf)),
    "operator_list": lambda s, sf: ops.operator_list(bound(s, sf, "operator_log")),
    "sap_orders": _sap_orders,
    "downtime_log": _downtime_log,
    "mold_changes": lambda s, sf: _changes(ops.mold_changes, s, sf),
    "mold_change_quality": lambda s, sf: ops.mold_change_quality(
        _changes(ops.mold_changes, s, sf, NO_FILTER, None, False)),
    "mold_change_kpi": lambda s, sf: _changes(ops.mold_change_kpi, s, sf),
    "mold_change_kpi_summary": lambda s, sf: ops.mold_change_kpi_summary(
        _changes(ops.mold_change_kpi, s, sf, NO_FILTER, None, False)),
    "mold_change_trend": lambda s, sf: _changes(ops.mold_change_trend, s, sf),
    "materials_list": _materials_list,
    "planned_material_need": _planned,
    "material_use_by_order": _by_order,
    "material_daily_trend": _trend,
    "material_summary": _materials,
    "material_totals": lambda s, sf: ops.material_totals(
        _planned(s, sf, limit=None, ordered=False), _by_order(s, sf, limit=None, ordered=False)),
    "table_row_counts": lambda s, sf: ops.table_row_counts(bound_tables(s, sf)),
}

# Reports without their limit, and reports under filters.
VARIANTS: dict[str, Query] = {
    "filter_articles__narrowed": _choices(
        ops.filter_articles,
        FilterSpec(workshop="NATION_3", molds=["Brand#2", "Brand#7", "Brand#11"])),
    "filter_molds__narrowed": _choices(
        ops.filter_molds, FilterSpec(workshop="NATION_3")),
    "machine_kpi__all": lambda s, sf: _machines(s, sf, limit=None),
    "machine_kpi__filtered": lambda s, sf: _machines(s, sf, RUNS_FILTER),
    "machine_kpi__molds": lambda s, sf: _machines(s, sf, MOLD_FILTER),
    "mold_kpi__filtered": lambda s, sf: _molds(s, sf, RUNS_FILTER),
    "downtime_pareto__all": lambda s, sf: _downtimes(s, sf, limit=None),
    "downtime_pareto__filtered": lambda s, sf: _downtimes(s, sf, EVENT_FILTER),
    "scrap_pareto__all": lambda s, sf: _scraps(s, sf, limit=None),
    "scrap_pareto__filtered": lambda s, sf: _scraps(s, sf, FilterSpec(
        start_date="1997-01-01", end_date="1999-12-31", shift="A", workshop="NATION_3",
        molds=["Brand#2", "Brand#7", "Brand#11"])),
    "energy_alerts__days": lambda s, sf: _alerts(ops.energy_alerts, s, sf, EVENT_DAYS),
    "energy_stops__all": lambda s, sf: ops.energy_stops(
        bound(s, sf, "energy_stops"), limit=None),
    "energy_stops__days": lambda s, sf: ops.energy_stops(
        bound(s, sf, "energy_stops"), EVENT_DAYS),
    "operator_time__filtered": lambda s, sf: _operator_time(
        s, sf, "2024-01-05", "2024-01-20", None, "click"),
    "iluo_matrix__like": lambda s, sf: ops.iluo_matrix(
        _operator_time(s, sf), {"L": 100_000, "U": 200_000, "O": 900_000}, " 1 "),
    "sap_orders__all": lambda s, sf: _sap_orders(s, sf, limit=None),
    "sap_orders__days": lambda s, sf: _sap_orders(s, sf, FilterSpec(
        start_date="1997-01-01", end_date="1997-12-31", molds=["Brand#2", "Brand#7"]), None),
    "downtime_log__all": lambda s, sf: _downtime_log(s, sf, None),
    "mold_changes__all": lambda s, sf: _changes(ops.mold_changes, s, sf, NO_FILTER, None),
    "mold_changes__filtered": lambda s, sf: _changes(
        ops.mold_changes, s, sf, CLICK_VIEW, None),
    "mold_change_kpi__filtered": lambda s, sf: _changes(ops.mold_change_kpi, s, sf, CLICK_VIEW),
    "planned_material_need__all": lambda s, sf: _planned(s, sf, limit=None),
    "planned_material_need__material": lambda s, sf: _planned(s, sf, MATERIAL_FILTER),
    "material_use_by_order__all": lambda s, sf: _by_order(s, sf, limit=None),
    "material_use_by_order__filtered": lambda s, sf: _by_order(
        s, sf, USE_FILTER),
    "material_daily_trend__filtered": lambda s, sf: _trend(s, sf, USE_FILTER),
    "material_summary__filtered": lambda s, sf: _materials(s, sf, RUNS_FILTER),
    # Totals and shares of the rows shown only.
    "machine_kpi_summary__shown": lambda s, sf: ops.machine_kpi_summary(
        _machines(s, sf, limit=20)),
    "energy_alert_rollup__shown": lambda s, sf: _alerts(
        ops.energy_alert_rollup, s, sf, NO_FILTER, 500),
    "mold_change_quality__shown": lambda s, sf: ops.mold_change_quality(
        _changes(ops.mold_changes, s, sf, NO_FILTER, 100)),
    "material_totals__shown": lambda s, sf: ops.material_totals(_planned(s, sf), _by_order(s, sf)),
    "downtime_pareto__shown": lambda s, sf: _downtimes(s, sf, share_of="shown"),
    "scrap_pareto__shown": lambda s, sf: _scraps(s, sf, share_of="shown"),
    # Machines and articles.
    "machine_kpi__codes": lambda s, sf: _machines(s, sf, CODES),
    "mold_kpi__codes": lambda s, sf: _molds(s, sf, CODES),
    "mold_kpi__all": lambda s, sf: _molds(s, sf, limit=None),
    "downtime_pareto__codes": lambda s, sf: _downtimes(s, sf, CODES),
    "scrap_pareto__codes": lambda s, sf: _scraps(s, sf, CODES),
    "energy_alerts__codes": lambda s, sf: _alerts(ops.energy_alerts, s, sf, MACHINES_ONLY),
    "energy_alert_rollup__codes": lambda s, sf: _alerts(
        ops.energy_alert_rollup, s, sf, MACHINES_ONLY),
    "energy_alert_rollup__days": lambda s, sf: _alerts(
        ops.energy_alert_rollup, s, sf, EVENT_DAYS),
    "energy_stops__codes": lambda s, sf: ops.energy_stops(
        bound(s, sf, "energy_stops"), MACHINES_ONLY),
    "operator_time__operator": lambda s, sf: _operator_time(s, sf, None, None, " 11 "),
    "sap_orders__codes": lambda s, sf: _sap_orders(s, sf, CODES),
    "sap_orders__machines": lambda s, sf: _sap_orders(s, sf, MACHINES_ONLY),
    "mold_changes__codes": lambda s, sf: _changes(ops.mold_changes, s, sf, MACHINES_ONLY),
    "mold_change_kpi__codes": lambda s, sf: _changes(ops.mold_change_kpi, s, sf, MACHINES_ONLY),
    "mold_change_trend__codes": lambda s, sf: _changes(
        ops.mold_change_trend, s, sf, MACHINES_ONLY),
    "mold_change_trend__days": lambda s, sf: _changes(ops.mold_change_trend, s, sf, EVENT_DAYS),
    "planned_material_need__codes": lambda s, sf: _planned(s, sf, MACHINES_ONLY),
    "material_use_by_order__codes": lambda s, sf: _by_order(s, sf, MACHINES_ONLY),
    "material_daily_trend__codes": lambda s, sf: _trend(s, sf, MACHINES_ONLY),
    "material_summary__codes": lambda s, sf: _materials(s, sf, MACHINES_ONLY),
    "material_summary__all": lambda s, sf: _materials(s, sf, limit=None),
    "energy_power": lambda s, sf: power_by_minute(bound(s, sf, "power_readings")).drop("minute_end"),
    "energy_power__closed": _closed_power,
    "energy_power__streamed": _streamed_power,
    "mold_changes__detected_first": lambda s, sf: ops.mold_changes(
        bound(s, sf, "production_runs"), bound(s, sf, "downtimes"), CLICK_VIEW, None,
        detect_before_filter=True),
    "iluo_matrix__pivot": lambda s, sf: ops.iluo_pivot(ops.iluo_matrix(_operator_time(s, sf))),
    "iluo_matrix__pivot_hours": lambda s, sf: ops.iluo_pivot(
        ops.iluo_matrix(_operator_time(s, sf, "2024-01-05", "2024-01-20")), "hours"),
    # Tables stored by day and machine.
    "energy_live__stored": lambda s, sf: ops.energy_live(
        _stored(s, sf, "energy_readings").energy_readings),
    "energy_alerts__stored": lambda s, sf: ops.energy_alerts(
        _stored(s, sf, "energy_alerts").energy_alerts, EVENT_DAYS, 500),
    "downtime_log__stored": _stored_log,
    "mold_changes__stored": _stored_changes,
}


def queries() -> dict[str, Query]:
    return {**HEADLINE, **VARIANTS}
