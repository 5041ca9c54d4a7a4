"""Operator time per machine and skill levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from presswork.filters import ALL, FilterSpec, not_blank
from presswork.functions import round_to

NO_MACHINE = "-"
# Fixed values of the result: seconds from which a level is reached; below L the level is I.
LEVELS = {"L": 144_000, "U": 288_000, "O": 1_728_000}


def operator_time(
    log: DataFrame, from_date: str | None = None, to_date: str | None = None,
    operator: str | None = None, machine: str | None = None,
) -> DataFrame:
    """Seconds per operator and machine, most first."""
    spec = FilterSpec(start_date=from_date, end_date=to_date)
    log = spec.apply(
        log.where(F.col("operator_code").isNotNull() & (F.col("duration_s") > 0)),
        days="shift_start")
    if operator and operator.strip():
        log = log.where(F.col("operator_code") == operator.strip())
    if machine and machine.strip() not in ("", ALL):
        log = log.where(F.col("machine_code") == machine.strip())
    return (
        log.groupBy("operator_code", "machine_code")
        .agg(F.sum("duration_s").alias("seconds"))
        .orderBy(F.desc("seconds"), "operator_code", "machine_code")
    )


def iluo_matrix(
    time: DataFrame, thresholds: Mapping[str, int] = LEVELS, operator_like: str | None = None
) -> DataFrame:
    """Hours and skill level for the rows of :func:`operator_time`."""
    wanted = (operator_like or "").strip().lower()
    if wanted:
        time = time.where(F.lower("operator_code").contains(wanted))
    level = F.when(F.col("seconds") >= thresholds["O"], "O")
    for name in ("U", "L"):
        level = level.when(F.col("seconds") >= thresholds[name], name)
    return time.withColumns({
        "hours": round_to(F.col("seconds") / F.lit(3600.0), 1),
        "level": level.otherwise("I"),
    })


def iluo_pivot(matrix: DataFrame, show: str = "level", most: int = 1000) -> DataFrame:
    """The rows of :func:`iluo_matrix` as a table: a row per operator, a column per machine.

    Cells hold the ``show`` column, null where the operator never worked on the
    machine. Columns are the machine codes that occur, in their order; work
    without a machine is the last one, ``-``. The codes are looked up first, at
    most ``most``: more are an error, since each would be a column. Operators
    come in order. No work gives no rows, and no column but the operator.
    """
    if show not in ("level", "hours", "seconds"):
        raise ValueError(f"cells show level, hours or seconds, not {show!r}")
    found = matrix.select("machine_code").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"there are more than {most} machines; narrow the filter or raise the bound")
    codes = sorted(r.machine_code for r in found if r.machine_code is not None)
    without = any(r.machine_code is None for r in found)
    if {"operator_code", NO_MACHINE if without else None} & {c.lower() for c in codes}:
        raise ValueError("a machine has the name of another column")
    named = matrix.withColumn("machine_code", F.coalesce("machine_code", F.lit(NO_MACHINE)))
    columns = [*codes, *[NO_MACHINE] * without]
    if not columns:
        return matrix.select("operator_code")
    return (named.groupBy("operator_code").pivot("machine_code", columns)
            .agg(F.first(show)).orderBy("operator_code"))


def operator_list(log: DataFrame) -> DataFrame:
    """Operator codes in use."""
    return (
        log.where(not_blank("operator_code"))
        .select("operator_code").distinct().orderBy("operator_code")
    )
