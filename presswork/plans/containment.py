"""The latest interval that lies inside a window of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Cell widths in seconds, widest first.
GRIDS = (4096, 64, 1)

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_NEVER = "CAST(NULL AS TIMESTAMP_NTZ)"


def _number(time: str) -> str:
    """The cell of a time, counted from 1970."""
    return f"floor(unix_timestamp({time}) / greatest(grid, 1))"


def _starts(number: str) -> str:
    return f"timestampadd(SECOND, {number} * grid, {_EPOCH})"


def _entry(time: str, latest: str, rising: bool = True) -> str:
    """A stretch end or a probe, at its place in the running maximum of a cell.

    Cells are named by their start, so that grid 0, where every time is a cell
    of its own, needs no other type.
    """
    place = f"{time} - {_EPOCH}" if rising else f"{_EPOCH} - {time}"
    return (
        f"named_struct('rising', {rising}, "
        f"'cell', CASE WHEN grid = 0 THEN {time} ELSE {_starts(_number(time))} END, "
        f"'place', {place}, 'latest', {latest})"
    )


def latest_end_within(
    spans: DataFrame,
    probes: DataFrame,
    before_s: int,
    after_s: int,
    grids: tuple[int, ...] = GRIDS,
) -> DataFrame:
    """Latest end among the spans inside ``[probe - before_s, probe + after_s]``.

    ``spans`` has ``key, start, seconds`` (whole, positive) and ``probes`` has
    ``key, probe``. Returns one row ``key, probe, latest`` per probe that finds
    a span.

    No span is ever paired with the probes around it. All windows are equally
    long, so a span fits if the window's end ``b`` lies between the span's end
    ``e`` and ``start + length``. That makes the span a *stretch* of the time
    axis, and a probe asks for the greatest ``e`` of the stretches over ``b``.
    The axis is cut into cells. A stretch of at least one cell width has its
    ends in different cells, and from a cell's point of view it

    * covers the cell: every ``b`` in it counts,
    * opens in it: ``b`` counts from ``e`` on,
    * closes in it: ``b`` counts up to the stretch's end.

    The first two are a running maximum over time in the cell, the third is
    one over falling time. Stretches shorter than a cell go to the next finer
    grid; a probe asks each grid once and in both directions. Stretches of
    length zero are matched on the exact time (grid 0). The largest group is
    what one key has in one cell.
    """
    length = before_s + after_s
    levels = " ".join(f"WHEN {length} - seconds >= {width} THEN {width}" for width in grids)
    stretches = spans.where(F.col("seconds").between(1, length)).selectExpr(
        "key",
        f"CASE {levels} ELSE 0 END AS grid",
        "timestampadd(SECOND, seconds, start) AS opens",
        f"timestampadd(SECOND, {length}, start) AS closes",
    )
    ends = stretches.selectExpr(
        "key", "grid", f"{_NEVER} AS probe",
        f"inline(array({_entry('opens', 'opens')}, {_entry('closes', 'opens', rising=False)}))",
    ).where("rising OR grid > 0")

    # One row per pair of end cells before the cells between are written out.
    covers = (
        stretches.where("grid > 0")
        .selectExpr("key", "grid", "opens AS latest",
                    f"{_number('opens')} AS opened", f"{_number('closes')} AS closed")
        .where("closed - opened > 1")
        .groupBy("key", "grid", "opened", "closed")
        .agg(F.max("latest").alias("latest"))
        .selectExpr("key", "grid", "latest",
                    "explode(sequence(opened + 1, closed - 1)) AS between")
        .selectExpr("key", "grid", "latest", f"{_starts('between')} AS cell")
        .selectExpr("key", "grid", f"{_NEVER} AS probe", "true AS rising", "cell",
                    f"cell - {_EPOCH} AS place", "latest")
    )

    asked = (
        probes.selectExpr(
            "key", f"explode(array({', '.join(map(str, (*grids, 0)))})) AS grid", "probe",
            f"timestampadd(SECOND, {after_s}, probe) AS until")
        .selectExpr(
            "key", "grid", "probe",
            f"inline(array({_entry('until', _NEVER)}, {_entry('until', _NEVER, rising=False)}))")
        .where("rising OR grid > 0")
    )

    in_cell = (
        Window.partitionBy("key", "grid", "cell", "rising").orderBy("place")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ends.unionByName(covers).unionByName(asked)
        .withColumn("latest", F.max("latest").over(in_cell))
        .where("probe IS NOT NULL AND latest IS NOT NULL")
        .groupBy("key", "probe")
        .agg(F.max("latest").alias("latest"))
    )
