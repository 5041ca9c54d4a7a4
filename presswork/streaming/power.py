"""Total power and running machines per minute, as readings arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.functions import as_instant, from_instant, or_zero, round_to
from presswork.operators.energy import ACTIVE_KW

#: How late a reading may come and still count.
LATENESS = "10 minutes"
MINUTE = "1 minute"


def power_by_minute(
    readings: DataFrame, lateness: str = LATENESS, minute: str = MINUTE
) -> DataFrame:
    """Total power, running machines and readings per minute, of a table or a stream.

    The figures of :func:`presswork.operators.energy_live_summary`, for each
    minute of ``reading_ts`` instead of the latest time. ``readings`` may be a
    stream: a minute is final, and its state goes, once a reading has come that
    is ``lateness`` later than the minute's end; readings that come after that
    are left out. Over a table every reading counts. Readings without a time
    belong to no minute.
    """
    return (
        readings.where(F.col("reading_ts").isNotNull())
        .select(as_instant(F.col("reading_ts")).alias("at"), "kw")
        .withWatermark("at", lateness)
        .groupBy(F.window("at", minute).alias("minute"))
        .agg(
            round_to(or_zero(F.sum("kw")), 2).alias("total_kw"),
            F.count_if(F.col("kw") > ACTIVE_KW).alias("active_machines"),
            F.count(F.lit(1)).alias("machines"),
        )
        .select(from_instant(F.col("minute.start")).alias("minute"),
                from_instant(F.col("minute.end")).alias("minute_end"),
                "total_kw", "active_machines", "machines")
    )


def closed(power: DataFrame, readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The minutes of a table's :func:`power_by_minute` that a stream of the same readings has closed."""
    latest = readings.agg(F.max("reading_ts") - F.expr(f"INTERVAL {lateness}")).scalar()
    return power.where(F.col("minute_end") <= latest)


def keep_power(
    readings: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS,
    minute: str = MINUTE, every: str | None = None,
) -> StreamingQuery:
    """Starts to append the minutes of a stream of readings to Parquet files, each when it is final.

    Without ``every`` the query takes what is there and ends; a later call goes on
    from ``checkpoint``. With ``every`` ("1 minute") it goes on until stopped.
    Both folders are ones that all executors share. A minute is written once,
    also if the query is killed and started again.
    """
    writer = (power_by_minute(readings, lateness, minute).writeStream.format("parquet")
              .outputMode("append").option("path", path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
