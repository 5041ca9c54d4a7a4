"""Output, scrap and OEE per machine and per mold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec
from presswork.functions import label_or_code, or_zero, percent, round_to, share
from presswork.plans.ranking import ranked

# Fixed values of the result.
SUMMARY_CODE = "CELKEM"
SUMMARY_NAME = "Souhrn za výběr"
NO_MOLD = "Nespecifikováno"


def _selected(results: DataFrame, spec: FilterSpec) -> DataFrame:
    return spec.apply(
        results, days="shift_start", shift="shift", workshop="workshop",
        machines="machine_code", molds="mold_code", articles="product_code")


def _totals() -> list[Column]:
    return [
        F.sum(or_zero("qty_made")).alias("pieces"),
        F.sum(or_zero("qty_scrap")).alias("scrap_pieces"),
        F.sum(or_zero("time_useful")).alias("_useful"),
        F.sum(or_zero("time_open")).alias("_open"),
    ]


def _scrap_pct() -> Column:
    return percent(F.col("scrap_pieces"), F.col("pieces")).alias("scrap_pct")


def _oee_pct() -> Column:
    return percent(F.col("_useful"), F.col("_open")).alias("oee_pct")


def machine_kpi(
    results: DataFrame, spec: FilterSpec = EVERYTHING, limit: int | None = 100,
    ordered: bool = True,
) -> DataFrame:
    """KPIs per machine code and name, most pieces first; unsorted if not ``ordered`` and whole.

    Rates are plain means over the runs, a missing rate counting as 0. OEE is
    useful time over open time.
    """
    rates = ("availability", "performance", "quality")
    machines = (
        _selected(results, spec)
        .groupBy("machine_code", "machine_name")
        .agg(*_totals(), *(F.avg(or_zero(rate)).alias(rate) for rate in rates))
        .select(
            "machine_code",
            label_or_code("machine_name", "machine_code").alias("machine_name"),
            "pieces", "scrap_pieces", _scrap_pct(),
            *(round_to(F.col(rate) * F.lit(100.0), 2).alias(f"{rate}_pct") for rate in rates),
            _oee_pct(),
        )
    )
    return ranked(machines, F.desc("pieces"), limit=limit, ordered=ordered)


def machine_kpi_summary(kpi: DataFrame) -> DataFrame:
    """One row over the rows of :func:`machine_kpi`; none if there are none.

    For the total of all machines give it the KPIs without a limit, and not ordered.

    OEE is the mean of the rounded values, weighted by pieces, or the plain
    mean if nothing was made.
    """
    return (
        kpi.agg(
            F.sum("pieces").alias("pieces"),
            F.sum("scrap_pieces").alias("scrap_pieces"),
            F.sum(F.col("oee_pct") * F.col("pieces")).alias("_weighted"),
            F.avg("oee_pct").alias("_mean"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .where(F.col("_rows") > 0)
        .select(
            F.lit(SUMMARY_CODE).alias("machine_code"),
            F.lit(SUMMARY_NAME).alias("machine_name"),
            "pieces", "scrap_pieces",
            share(F.col("scrap_pieces"), F.col("pieces")).alias("scrap_pct"),
            round_to(
                F.when(F.col("pieces") > 0, F.col("_weighted") / F.col("pieces"))
                .otherwise(F.col("_mean")), 2).alias("oee_pct"),
        )
    )


def mold_kpi(
    results: DataFrame, spec: FilterSpec = EVERYTHING, limit: int | None = 30
) -> DataFrame:
    """KPIs per mold code and name, most pieces first."""
    molds = (
        _selected(results, spec)
        .groupBy("mold_code", "mold_name")
        .agg(*_totals())
        .select(
            F.coalesce("mold_code", F.lit(NO_MOLD)).alias("mold_code"),
            label_or_code("mold_name", "mold_code").alias("mold_name"),
            "pieces", "scrap_pieces", _scrap_pct(), _oee_pct(),
        )
    )
    return ranked(molds, F.desc("pieces"), limit=limit)
