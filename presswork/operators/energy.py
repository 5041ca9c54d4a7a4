"""Energy alerts, live power and consumption during stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec
from presswork.functions import hours_between, or_zero, round_to
from presswork.plans.ranking import newest, ranked
from presswork.schemas import DAY

# Fixed values of the result.
UNKNOWN_MACHINE = "Neznámý lis"
ACTIVE_KW = 1.0


def energy_alerts(
    alerts: DataFrame, spec: FilterSpec = EVERYTHING, limit: int | None = 5000,
    ordered: bool = True,
) -> DataFrame:
    """Latest alerts, newest shift first; unsorted if not ``ordered`` and whole."""
    selected = spec.apply(alerts, days="shift_start", machines="machine_code")
    selected = newest(selected, "shift_start", limit).select(
        "shift_start", "shift_end", "machine_code", "shift", "order_type", "event_type",
        "alert_start", "alert_end", round_to(or_zero("kwh"), 2).alias("kwh"))
    return ranked(selected, F.desc("shift_start"), limit=limit, ordered=ordered)


def energy_alert_rollup(
    alerts: DataFrame, spec: FilterSpec = EVERYTHING, limit: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Alerts, hours and consumption per machine over all alerts, or the latest ``limit``.

    An alert without an end after its start is counted with 0 hours. Machines
    come by consumption, highest first, unless ``ordered`` is false; the alerts
    are summed without an order in any case.
    """
    machine = F.coalesce(F.nullif(F.trim("machine_code"), F.lit("")), F.lit(UNKNOWN_MACHINE))
    totals = (
        energy_alerts(alerts, spec, limit, ordered=False)
        .groupBy(machine.alias("machine_code"))
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            F.sum(hours_between(F.col("alert_start"), F.col("alert_end"))).alias("hours"),
            F.sum("kwh").alias("kwh"),
        )
    )
    rollup = totals.select(
        "machine_code", "alerts",
        round_to(F.col("hours"), 2).alias("hours"), round_to(F.col("kwh"), 2).alias("kwh"))
    return rollup.orderBy(F.desc("kwh"), "machine_code") if ordered else rollup


def energy_live(readings: DataFrame) -> DataFrame:
    """Readings at the latest time, highest power first.

    The latest time comes from a scan of that column alone, and reaches the
    second scan as a pushed filter. Stored readings are first cut to the last
    day, which is found from the names of the partitions and the files' footers.
    """
    if DAY in readings.columns:
        readings = readings.where(F.col(DAY) == readings.agg(F.max(DAY)).scalar())
    latest = readings.agg(F.max("reading_ts")).scalar()
    return (
        readings.where(F.col("reading_ts") == latest)
        .orderBy(F.desc("kw"), "machine_code")
        .select("machine_code", "reading_ts", round_to(F.col("kw"), 2).alias("kw"))
    )


def energy_live_summary(live: DataFrame) -> DataFrame:
    """Latest time, total power, and how many readings show a running machine."""
    return live.agg(
        F.max("reading_ts").alias("reading_ts"),
        round_to(or_zero(F.sum("kw")), 2).alias("total_kw"),
        F.count_if(F.col("kw") > ACTIVE_KW).alias("active_machines"),
        F.count(F.lit(1)).alias("machines"),
    )


def energy_stops(
    stops: DataFrame, spec: FilterSpec = EVERYTHING, limit: int | None = 50
) -> DataFrame:
    """Stops that consumed energy, most first. Days are those of the shift."""
    consuming = spec.apply(
        stops.where(F.col("kwh") > 0), days="shift_start", machines="machine_code"
    ).select("machine_code", "stop_code", "stop_start", "stop_end", "kwh")
    return ranked(consuming, F.desc("kwh"), limit=limit).withColumn(
        "kwh", round_to(F.col("kwh"), 2))
