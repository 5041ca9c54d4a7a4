"""Production orders and their progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec
from presswork.functions import label_or_code, or_zero, round_to
from presswork.plans.ranking import named_by, ranked

RUNNING, PLANNED = "L", "D"
# Fixed values of the result.
STATUS_TEXT = {"L": "Běží", "D": "Naplánováno", "S": "Dokončeno", "T": "Dokončeno"}
MISSING = "-"


def _selected(headers: DataFrame, spec: FilterSpec) -> DataFrame:
    headers = spec.apply(headers, machines="machine_code", molds="mold_code")
    if spec.start_date and spec.end_date:
        first, last = spec.on_days(F.coalesce("actual_start", "planned_start"))
        headers = headers.where((F.col("status_code") == RUNNING) | (first & last))
    return headers


def _line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_code").agg(
        F.max("product_code").alias("product_code"),
        F.sum(or_zero("qty_planned")).alias("planned_pieces"),
        F.sum(or_zero("qty_good")).alias("good_pieces"),
        F.sum(or_zero("qty_scrap")).alias("scrap_pieces"),
    )


def _progress() -> Column:
    """Good pieces against planned pieces, or against strokes if no pieces are planned."""
    target = F.when(F.col("planned_pieces") != 0, F.col("planned_pieces")).otherwise(
        F.col("strokes"))
    return round_to(
        F.when(target == 0, F.lit(0.0))
        .otherwise(F.col("good_pieces") / target * F.lit(100.0)), 1)


def _first(orders: DataFrame, limit: int | None) -> DataFrame:
    """Running orders, then planned ones, then the rest; newest first."""
    rank = (
        F.when(F.col("status_code") == RUNNING, 0)
        .when(F.col("status_code") == PLANNED, 1)
        .otherwise(2)
    )
    return ranked(orders, rank, F.desc("seq_no"), limit=limit)


def sap_orders(
    headers: DataFrame, lines: DataFrame, spec: FilterSpec = EVERYTHING,
    limit: int | None = 100,
) -> DataFrame:
    """Orders with the totals of their lines, progress and status.

    Running orders pass the date filter in any case; it applies only if both
    ends are given. The article filter is on the greatest product code of the
    order.

    The ranking depends on the headers alone, so unless articles are filtered
    the codes of the orders to show are found first, in a scan of the columns
    that rank them, and a semi-join cuts headers and lines to these before any
    of them is shuffled for the join.
    """
    columns = [
        "order_code", "machine_code", "machine_name", "mold_code", "mold_name", "strokes",
        "status_code", "actual_start", "planned_start", "seq_no",
    ]
    orders = _selected(headers, spec).select(*columns)
    if spec.articles is None and limit is not None:
        shown = _first(orders.select("order_code", "status_code", "seq_no"), limit)
        orders = named_by(orders, shown, "order_code")
        lines = named_by(lines, shown, "order_code")
    joined = orders.join(_line_totals(lines), "order_code", "left")
    joined = spec.apply(joined, articles="product_code")

    code = F.upper(F.coalesce("status_code", F.lit(PLANNED)))
    status = code
    for value, text in STATUS_TEXT.items():
        status = F.when(code == value, text).otherwise(status)
    totals = {c: or_zero(c) for c in ("strokes", "planned_pieces", "good_pieces", "scrap_pieces")}
    return _first(joined.select(*columns, "planned_pieces", "good_pieces", "scrap_pieces"),
                  limit).withColumns(totals).select(
        "order_code",
        F.coalesce("machine_code", F.lit(MISSING)).alias("machine_code"),
        label_or_code("machine_name", "machine_code").alias("machine_name"),
        F.coalesce("mold_code", F.lit(MISSING)).alias("mold_code"),
        label_or_code("mold_name", "mold_code").alias("mold_name"),
        "strokes", "planned_pieces", "good_pieces", "scrap_pieces",
        _progress().alias("progress_pct"),
        status.alias("status"), code.alias("status_code"),
        (code == RUNNING).alias("is_active"),
        "actual_start", "planned_start",
    )
