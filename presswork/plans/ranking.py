"""Deterministic ordering and top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.functions import share
from presswork.schemas import DAY


def ranked(
    df: DataFrame, *first: Column, limit: int | None = None, ordered: bool = True
) -> DataFrame:
    """``df`` ordered by ``first`` and then by all its columns, cut to ``limit`` rows.

    Ordering by every column makes the cut well defined: rows that still tie
    are equal. With a limit Spark keeps only the best rows of each partition
    (TakeOrderedAndProject), and gathers these in one task: a limit is for short
    lists, ``limit=None`` sorts over all tasks. Without a limit ``ordered=False``
    leaves the rows as they are, for totals over them.
    """
    if limit is None and not ordered:
        return df
    df = df.orderBy(*first, *df.columns)
    return df if limit is None else df.limit(limit)


def share_of_total(df: DataFrame, value: str) -> Column:
    """Percentage of ``value`` in its sum over the rows of ``df``.

    The total is a one-row aggregate of its own. Where ``df`` is a grouped sum,
    Spark takes it from the shuffle that the sum has made already.
    """
    return share(F.col(value), df.agg(F.sum(value)).scalar())


def named_by(df: DataFrame, shown: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column``, a missing one included, is also in ``shown``.

    A semi-join: Spark knows how many rows a limit leaves, and sends the values
    to the scan of ``df`` while they are few; many are shuffled, like ``df``, by
    the value. So no task holds all values, whatever the limit.
    """
    # a name of its own, since both may come from one table
    values = shown.select(F.col(column).alias("_named"))
    return df.join(values, df[column].eqNullSafe(values["_named"]), "left_semi")


def newest(df: DataFrame, time: str, limit: int | None) -> DataFrame:
    """``df`` without the days that are too old to hold its newest ``limit`` rows.

    Rows are counted per day in a scan of ``time`` alone. The first day that is
    still needed then goes to the scan of all columns as a pushed filter, so
    that it reads, and the ranking gathers, little more than ``limit`` rows.
    Rows without a time sort last and stay in. Of stored facts the rows per day
    are counted from the files' footers, and older days are not opened.
    """
    if limit is None:
        return df
    kept = DAY in df.columns
    newer = Window.orderBy(F.desc("day")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    days = (
        df.groupBy(F.to_date(DAY if kept else time).alias("day"))
        .agg(F.count(F.lit(1) if kept else time).alias("rows"))
        .withColumn("rows", F.sum("rows").over(newer))
    )
    # The latest day with enough rows up to it, or the earliest if all are too few.
    first = days.agg(
        F.coalesce(F.max(F.when(F.col("rows") >= limit, F.col("day"))), F.min("day"))
        .cast("date" if kept else "timestamp_ntz")
    ).scalar()
    bounded = F.col(DAY if kept else time)
    return df.where((bounded >= first) | bounded.isNull())
