"""Downtime and scrap by cause, and the log of stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec, on_matching_machines
from presswork.functions import label_or_code, round_to
from presswork.plans.ranking import named_by, newest, ranked, share_of_total


def _by_cause(
    df: DataFrame, results: DataFrame, spec: FilterSpec, cause: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Sums per cause, over the machines that pass the workshop and mold filters.

    If there is such a filter, rows are summed per machine first, so that the
    semi-join sees one row per machine and cause instead of every stop.
    """
    if spec.workshop is None and spec.molds is None:
        return df.groupBy(*cause).agg(*(c.alias(name) for name, c in sums.items()))
    per_machine = df.groupBy("machine_code", *cause).agg(
        *(c.alias(name) for name, c in sums.items()))
    return (
        on_matching_machines(per_machine, results, spec)
        .groupBy(*cause)
        .agg(*(F.sum(name).alias(name) for name in sums))
    )


def _whole(causes: DataFrame, shown: DataFrame, share_of: str) -> DataFrame:
    if share_of not in ("all", "shown"):
        raise ValueError(f"shares are of 'all' or 'shown' causes, not of {share_of!r}")
    return causes if share_of == "all" else shown


def downtime_pareto(
    downtimes: DataFrame, results: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 15, share_of: str = "all",
) -> DataFrame:
    """Hours and number of stops per reason, most hours first.

    Shares are of the rounded hours of all reasons, or with ``share_of="shown"``
    of those within the limit. ``available_h`` repeats the hours. The article
    filter does not apply.
    """
    stops = spec.apply(
        downtimes.where(F.col("duration_s") > 0),
        days="start_ts", shift="shift", machines="machine_code")
    causes = _by_cause(
        stops, results, spec, ["reason_label", "reason_code"],
        {"_seconds": F.sum("duration_s"), "stops": F.count(F.lit(1))},
    ).select(
        label_or_code("reason_label", "reason_code", blank_is_missing=True).alias("reason"),
        round_to(F.col("_seconds") / F.lit(3600.0), 2).alias("hours"),
        "stops", "_seconds",
    )
    shown = ranked(causes, F.desc("_seconds"), limit=limit)
    share = share_of_total(_whole(causes, shown, share_of), "hours")
    return shown.select(
        "reason", "hours", "stops", F.col("hours").alias("available_h"),
        share.alias("share_pct"))


def scrap_pareto(
    scraps: DataFrame, results: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 15, share_of: str = "all",
) -> DataFrame:
    """Scrap pieces per defect, most pieces first.

    Shares are of the pieces of all defects, or with ``share_of="shown"`` of
    those within the limit.
    """
    rejects = spec.apply(
        scraps.where(F.col("qty") > 0),
        days="shift_start", shift="shift", machines="machine_code", articles="product_code")
    causes = _by_cause(
        rejects, results, spec, ["defect_label", "defect_code"], {"pieces": F.sum("qty")},
    ).select(
        label_or_code("defect_label", "defect_code", blank_is_missing=True).alias("defect"),
        "pieces",
    )
    shown = ranked(causes, F.desc("pieces"), limit=limit)
    share = share_of_total(_whole(causes, shown, share_of), "pieces")
    return shown.withColumn("share_pct", share)


def downtime_log(
    downtimes: DataFrame, orders: DataFrame, reasons: DataFrame, limit: int | None = 100
) -> DataFrame:
    """Latest stops with order code and reason.

    Stops are cut before the joins, which can only add rows, and once more
    after them: the joins see ``limit`` stops, and of the looked up tables only
    the rows that these stops name.
    """
    stops = downtimes.select("start_ts", "end_ts", "duration_s", "order_id", "reason_id")
    latest = newest(stops, "start_ts", limit)
    if limit is not None:
        latest = ranked(latest, F.desc("start_ts"), limit=limit)
    orders = orders.select(F.col("id").alias("order_id"), "order_code")
    reasons = reasons.select(F.col("id").alias("reason_id"), "reason")
    if limit is not None:
        orders = named_by(orders, latest, "order_id")
        reasons = named_by(reasons, latest, "reason_id")
    named = latest.join(orders, "order_id", "left").join(reasons, "reason_id", "left")
    ordered = named.select(*stops.columns, "order_code", "reason")
    return ranked(ordered, F.desc("start_ts"), limit=limit).select(
        "order_code", "start_ts", "end_ts", "duration_s", "reason")
