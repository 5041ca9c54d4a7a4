"""Mold changes: detection, durations, KPIs and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec
from presswork.functions import minute_diff, round_to
from presswork.plans.containment import latest_end_within
from presswork.plans.ranking import ranked
from presswork.plans.sequence import value_switches
from presswork.schemas import DAY

# Fixed values of the result: a change takes 1 minute to 8 hours; anything else is an anomaly.
MIN_MINUTES, MAX_MINUTES = 1, 480
# Stops count from 30 minutes before the old run's end to 16 hours after it.
BEFORE_S, AFTER_S = 30 * 60, 16 * 3600
# Fixed values of the result.
FROM_STOP, FROM_SHIFT = "PROSTOJ", "DEBEQU"


def _stops_near(downtimes: DataFrame, runs: DataFrame, spec: FilterSpec) -> DataFrame:
    """Stops without those that no run's window can reach.

    Under a day filter the times of the runs bound the stops' times; the bounds
    go to the scan of the stops. Without one they would span the whole table.
    """
    downtimes = spec.apply(downtimes, machines="machine_code")
    if spec.start_date or spec.end_date:
        def shifted(end: Column, seconds: int) -> Column:
            return F.timestamp_add("SECOND", F.lit(seconds), end)
        # Spark would merge two aggregates into one subquery with two fields, and push neither.
        first = runs.agg(shifted(F.min("shift_end"), -BEFORE_S)).scalar()
        last = (
            runs.orderBy(F.desc("shift_end")).limit(1)
            .select(shifted(F.col("shift_end"), AFTER_S)).scalar()
        )
        downtimes = downtimes.where(F.col("start_ts").between(first, last))
        if DAY in downtimes.columns:
            downtimes = downtimes.where(F.col(DAY).between(F.to_date(first), F.to_date(last)))
    return downtimes


def _last_before(runs: DataFrame, selected: DataFrame, spec: FilterSpec) -> DataFrame:
    """Of each machine in ``selected`` the last run before the first day of the filter.

    The latest time per machine comes from a scan of machine and time alone. The
    earliest of these times bounds the scan of whole runs, which then keeps one
    run per machine; runs without a time are before all others.
    """
    earlier = runs.where((F.to_date("shift_start") < F.lit(spec.start_date)) | F.col("shift_start").isNull())
    if DAY in runs.columns:
        earlier = earlier.where((F.col(DAY) < F.lit(spec.start_date)) | F.col(DAY).isNull())
    machines = selected.select("machine_code").distinct()
    latest = (earlier.select("machine_code", "shift_start").join(machines, "machine_code", "left_semi")
              .groupBy(F.col("machine_code").alias("_machine")).agg(F.max("shift_start").alias("_latest")))
    oldest = latest.agg(F.min("_latest")).scalar()
    near = earlier.where((F.col("shift_start") >= oldest) | F.col("shift_start").isNull())
    if DAY in runs.columns:
        near = near.where((F.col(DAY) >= F.to_date(oldest)) | F.col(DAY).isNull())
    last = near.join(latest, (F.col("machine_code") == F.col("_machine"))
                     & F.col("shift_start").eqNullSafe(F.col("_latest")))
    order = ["shift_start", "shift_end", "mold_code", "product_code"]
    found = last.groupBy("machine_code").agg(F.max(F.struct(*order)).alias("_last"))
    return found.select("machine_code", *(F.col(f"_last.{c}").alias(c) for c in order))


def _changes(
    runs: DataFrame, downtimes: DataFrame, spec: FilterSpec, by_mold: bool,
    detect_before_filter: bool = False,
) -> DataFrame:
    """Every change of mold on a machine, with its duration.

    The new mold starts at the end of the last stop within the window around
    the old run's end, or with its shift if there is none. Filters apply
    before runs are compared: "previous" is the previous run that passed them.
    With ``detect_before_filter`` it is the previous run of the machine, and the
    filters are on the run with the new mold. Stops are not filtered by date.
    """
    runs = runs.where(F.col("machine_code").isNotNull() & F.col("mold_code").isNotNull()).select(
        "machine_code", "mold_code", "shift_start", "shift_end",
        F.coalesce("product_code", F.lit("")).alias("product_code"), *[DAY] * (DAY in runs.columns))
    runs = spec.apply(runs, machines="machine_code")
    if by_mold and not detect_before_filter:
        runs = spec.apply(runs, molds="mold_code")
    selected = spec.apply(runs, days="shift_start").drop(DAY)
    if detect_before_filter and spec.start_date:
        selected = selected.unionByName(_last_before(runs, selected, spec))
    changes = value_switches(
        selected, key="machine_code", time="shift_start", value="mold_code", carry="shift_end",
        ties=("shift_end", "mold_code", "product_code"),
    ).select(
        "machine_code",
        F.col("previous_mold_code").alias("old_mold"),
        F.col("mold_code").alias("new_mold"),
        "product_code",
        F.col("previous_shift_end").alias("old_end"),
        "shift_start",
    )
    if by_mold and detect_before_filter:
        changes = spec.apply(changes, molds="new_mold")
    stops = latest_end_within(
        _stops_near(downtimes, selected, spec).select(
            F.col("machine_code").alias("key"), F.col("start_ts").alias("start"),
            F.col("duration_s").alias("seconds")),
        changes.select(F.col("machine_code").alias("key"), F.col("old_end").alias("probe")),
        BEFORE_S, AFTER_S,
    ).select(
        F.col("key").alias("machine_code"), F.col("probe").alias("old_end"),
        F.col("latest").alias("stop_end"))

    new_start = F.coalesce("stop_end", "shift_start")
    source = F.when(F.col("stop_end").isNotNull(), FROM_STOP).otherwise(FROM_SHIFT)
    return (
        changes.join(stops, ["machine_code", "old_end"], "left")
        .select(
            "machine_code", "old_mold", "new_mold", "product_code", "old_end",
            new_start.alias("new_start"), source.alias("time_source"),
            minute_diff(F.col("old_end"), new_start).alias("minutes"),
        )
        .where(F.col("minutes").between(MIN_MINUTES, MAX_MINUTES))
    )


def _precise() -> Column:
    return F.count_if(F.col("time_source") == FROM_STOP)


def _mean_minutes() -> Column:
    return round_to(F.avg("minutes"), 1).alias("avg_min")


def mold_changes(
    runs: DataFrame, downtimes: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 500, ordered: bool = True, detect_before_filter: bool = False,
) -> DataFrame:
    """Single changes, latest first; unsorted if not ``ordered`` and whole.

    Days and molds cut the runs before these are compared, so a change at the
    start of the first day is not seen, and the old mold is the last selected
    one. With ``detect_before_filter`` changes are found among all runs of a
    machine; those to a selected mold on a selected day are shown. Of the runs
    before the first day one per machine is read whole.
    """
    changes = _changes(runs, downtimes, spec, True, detect_before_filter)
    return ranked(changes, F.desc("old_end"), limit=limit, ordered=ordered)


def mold_change_quality(changes: DataFrame) -> DataFrame:
    """How many of the rows of :func:`mold_changes` have a precise start.

    For the quality of all changes give it the changes without a limit, and not ordered.
    """
    return changes.agg(
        F.count(F.lit(1)).alias("changes"),
        _precise().alias("precise_changes"),
        F.count_if(F.col("time_source") == FROM_SHIFT).alias("estimated_changes"),
    )


def mold_change_kpi(
    runs: DataFrame, downtimes: DataFrame, spec: FilterSpec = EVERYTHING,
    changes: DataFrame | None = None, ordered: bool = True,
) -> DataFrame:
    """Durations per machine, longest mean first unless ``ordered`` is false.

    The mold filter does not apply.

    ``changes`` is the result of :func:`mold_changes` for the same tables and
    filter, without a mold filter or a limit, if it is at hand.
    """
    kpi = (
        (_changes(runs, downtimes, spec, by_mold=False) if changes is None else changes)
        .groupBy("machine_code")
        .agg(
            F.count(F.lit(1)).alias("changes"),
            _precise().alias("precise_changes"),
            _mean_minutes(),
            F.min("minutes").cast("double").alias("min_min"),
            F.max("minutes").cast("double").alias("max_min"),
            round_to(F.stddev_samp("minutes"), 1).alias("stddev_min"),
        )
    )
    return kpi.orderBy(F.desc("avg_min"), "machine_code") if ordered else kpi


def mold_change_kpi_summary(kpi: DataFrame) -> DataFrame:
    """Number of changes and the mean of the rounded means, weighted by changes."""
    total = F.sum("changes")
    weighted = F.sum(F.col("avg_min") * F.col("changes"))
    return kpi.agg(
        F.coalesce(total, F.lit(0)).alias("changes"),
        F.coalesce(round_to(weighted / total, 1), F.lit(0.0)).alias("avg_min"),
    )


def mold_change_trend(
    runs: DataFrame, downtimes: DataFrame, spec: FilterSpec = EVERYTHING,
    changes: DataFrame | None = None,
) -> DataFrame:
    """Changes and mean duration per day of the old run's end. The mold filter does not apply.

    ``changes`` as in :func:`mold_change_kpi`.
    """
    return (
        (_changes(runs, downtimes, spec, by_mold=False) if changes is None else changes)
        .groupBy(F.to_date("old_end").alias("day"))
        .agg(F.count(F.lit(1)).alias("changes"), _mean_minutes())
        .orderBy("day")
    )
