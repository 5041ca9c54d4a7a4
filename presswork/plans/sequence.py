"""The previous row of a key, for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.functions import epoch_seconds


def value_switches(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    carry: str,
    ties: Sequence[str],
    bucket_s: int = 3600,
) -> DataFrame:
    """Rows at which ``value`` differs from the previous row of the same ``key``.

    Rows of a key are ordered by ``time``, then ``ties``. The result has the
    columns of ``df`` plus ``previous_{value}`` and ``previous_{carry}``; rows
    whose previous ``carry`` is missing are left out.

    A plain window by ``key`` would sort all rows of a key in one task. Here
    the window runs per key and time bucket. Only its switches and the first
    and last row of each bucket go on to a second window, where the first row
    of a bucket finds the last row of the bucket before. That window sees two
    rows per bucket of a key, however many rows the key has.
    """
    previous = [f"previous_{value}", f"previous_{carry}"]
    order = [time, *ties]

    def lagged(window) -> list[Column]:
        return [F.lag(name).over(window) for name in (value, carry)]

    by_bucket = Window.partitionBy(key, "_bucket").orderBy(*order)
    within = df.withColumn(
        "_bucket", F.floor(epoch_seconds(F.col(time)) / bucket_s)
    ).withColumns({
        **dict(zip(previous, lagged(by_bucket))),
        "_first": F.lag(F.lit(1)).over(by_bucket).isNull(),
        "_last": F.lead(F.lit(1)).over(by_bucket).isNull(),
    })

    switched = (F.col(value) != F.col(previous[0])) & F.col(previous[1]).isNotNull()
    edge = F.col("_first") | F.col("_last")
    lane = F.when(edge, F.lit(None)).otherwise(F.col("_bucket"))
    by_lane = Window.partitionBy(key, "_lane").orderBy(*order)
    across = within.where(edge | switched).withColumn("_lane", lane)
    for name, found in zip(previous, lagged(by_lane)):
        across = across.withColumn(f"_{name}", found)
    chosen = {
        name: F.when(F.col("_first"), F.col(f"_{name}")).otherwise(F.col(name))
        for name in previous
    }
    return across.withColumns(chosen).where(switched).select(*df.columns, *previous)
