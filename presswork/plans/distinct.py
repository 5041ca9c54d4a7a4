"""Several distinct counts over one grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def counted(
    rows: DataFrame, keys: list[str], codes: dict[str, str], totals: list[str]
) -> DataFrame:
    """Per ``keys`` the sums of ``totals`` and how many values of each column of ``codes`` there are.

    ``codes`` maps columns to the names of their counts; missing values do not
    count. ``rows`` are sums per all codes, straight from their shuffle. Without
    ``keys`` the result is one row.

    Several distinct counts in one aggregate would send every row on once per
    count (Expand). Here each count regroups the rows by its own code, which
    shuffles one row per code that a task has. Each also adds up the totals, so
    that all need the same columns and start from the same shuffle, made once.
    Codes are neither numbered nor collected: a key may have any number of them.
    """
    def sums():
        return [F.sum(name).alias(name) for name in totals]

    parts = [
        rows.groupBy(*keys, code).agg(*sums()).groupBy(*keys).agg(*sums(), F.count(code).alias(name))
        for code, name in codes.items()
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.groupBy(*keys).agg(*(F.max(name).alias(name) for name in (*totals, *codes.values())))
