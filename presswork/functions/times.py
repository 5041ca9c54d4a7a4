"""Arithmetic on times without a zone; no result depends on the session zone."""

from pyspark.sql import Column, functions as F


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_timestamp(time)


def as_instant(time: Column) -> Column:
    """A time without a zone as the instant at which clocks in UTC show it; watermarks need one."""
    days = F.date_diff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(time)) * 60 + F.minute(time)
    micros = F.date_part(F.lit("SECOND"), time) * 1_000_000
    return F.timestamp_micros(minutes * 60_000_000 + micros.cast("long"))


def from_instant(instant: Column) -> Column:
    """The time without a zone that :func:`as_instant` made ``instant`` from."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def minute_diff(start: Column, end: Column) -> Column:
    """Number of minute boundaries crossed from ``start`` to ``end``."""
    def minute(time: Column) -> Column:
        return F.floor(epoch_seconds(time) / 60)
    return minute(end) - minute(start)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end``; 0 unless both are known and ``end`` is later."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.when(end > start, micros / F.lit(3.6e9)).otherwise(F.lit(0.0))
