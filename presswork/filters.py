"""The request filter shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from presswork.schemas import DAY

ALL = "ALL"


def _text(value: str | None) -> str | None:
    return (value or "").strip() or None


def _day(value: str | date | None) -> date | None:
    if isinstance(value, datetime):
        return value.date()
    if value is None or isinstance(value, date):
        return value
    return date.fromisoformat(value.strip()) if value.strip() else None


def _codes(values: str | Iterable[str] | None) -> tuple[str, ...] | None:
    if isinstance(values, str):
        values = (values,) if values.strip() else ()
    values = tuple(values or ())
    if not values or ALL in values:
        return None
    return tuple(v.strip() for v in values)


@dataclass(frozen=True)
class FilterSpec:
    """Optional restrictions; each operator says which of them it honours.

    Blank texts, empty lists and lists that hold ``"ALL"`` mean "no
    restriction". ``"ALL"`` is an ordinary value for shift and workshop.
    Days are inclusive at both ends; a bound with a time stands for its day. A
    single text for a list field is a list of that text.
    """

    start_date: str | date | None = None
    end_date: str | date | None = None
    shift: str | None = None
    workshop: str | None = None
    machines: str | Iterable[str] | None = None
    molds: str | Iterable[str] | None = None
    articles: str | Iterable[str] | None = None
    material: str | None = None

    def __post_init__(self) -> None:
        clean = {
            "start_date": _day(self.start_date),
            "end_date": _day(self.end_date),
            "shift": _text(self.shift),
            "workshop": _text(self.workshop),
            "machines": _codes(self.machines),
            "molds": _codes(self.molds),
            "articles": _codes(self.articles),
            "material": None if _text(self.material) == ALL else _text(self.material),
        }
        for name, value in clean.items():
            object.__setattr__(self, name, value)

    def on_days(self, time: Column) -> list[Column]:
        """``time`` falls on a day of the range; reaches the Parquet scan as a time range."""
        day = F.to_date(time)
        found = []
        if self.start_date:
            found.append(day >= F.lit(self.start_date))
        if self.end_date:
            found.append(day <= F.lit(self.end_date))
        return found

    def apply(self, df: DataFrame, **columns: str) -> DataFrame:
        """Keep the rows of ``df`` that pass the named restrictions.

        ``columns`` maps a restriction (``days``, ``shift``, ``workshop``,
        ``machines``, ``molds``, ``articles``, ``material``) to the column it
        applies to; restrictions that are not named are ignored. Stored facts
        are cut to their days by the partition column, too.
        """
        for field, column in columns.items():
            if field == "days":
                for time in [column, *[DAY] * (DAY in df.columns)]:
                    for predicate in self.on_days(F.col(time)):
                        df = df.where(predicate)
                continue
            wanted = getattr(self, field)
            if wanted is None:
                continue
            if isinstance(wanted, tuple):
                df = df.where(F.col(column).isin(*wanted))
            else:
                df = df.where(F.col(column) == F.lit(wanted))
        return df


EVERYTHING = FilterSpec()


def not_blank(column: str) -> Column:
    """Canonical texts are trimmed, so a plain comparison does, and reaches the scan."""
    return F.col(column) != ""


def on_matching_machines(df: DataFrame, results: DataFrame, spec: FilterSpec) -> DataFrame:
    """Keep rows whose machine ran in the workshop, and ran one of the molds.

    The two conditions are independent: the machine may have met them in
    different runs. Machine codes are made distinct first, so that only
    machine codes, and no production rows, are shuffled or broadcast.
    """
    for field, column in (("workshop", "workshop"), ("molds", "mold_code")):
        if getattr(spec, field) is not None:
            machines = spec.apply(results, **{field: column}).select("machine_code").distinct()
            df = df.join(machines, "machine_code", "left_semi")
    return df
