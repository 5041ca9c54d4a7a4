from pyspark.sql import Column, functions as F


def round_to(value: Column, places: int) -> Column:
    """Round half away from zero.

    The detour over a decimal drops the noise of binary sums below 1e-6, so
    that the result does not depend on the order of summation.
    """
    return F.round(value.cast("decimal(28,6)"), places).cast("double")


def or_zero(value: str | Column) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` to two places; 0 if the whole is 0 or missing."""
    ratio = F.when(whole != 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))
    return round_to(ratio, 2)


def share(part: Column, whole: Column) -> Column:
    """Percentage of a total; 0 also if corrections make the total negative."""
    return percent(part, F.when(whole > 0, whole))
