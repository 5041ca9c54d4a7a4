"""Size of the tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from presswork.plans.ranking import ranked


def table_row_counts(tables: Mapping[str, DataFrame], limit: int | None = 20) -> DataFrame:
    """Row count of each table that has rows, largest first.

    Rows are counted where they are read; one row per table and task is shuffled.
    """
    named = [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()]
    counts = (
        reduce(DataFrame.unionByName, named)
        .groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    )
    return ranked(counts, F.desc("row_count"), limit=limit)
