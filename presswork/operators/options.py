"""Choices for the filter fields: distinct codes and labels, in label order."""

from pyspark.sql import DataFrame, functions as F

from presswork.filters import EVERYTHING, FilterSpec, not_blank
from presswork.functions import label_or_code


def _codes_and_labels(results: DataFrame, code: str, label: str) -> DataFrame:
    return (
        results.where(not_blank(code))
        .select(code, label_or_code(label, code).alias(label))
        .distinct()
        .orderBy(label, code)
    )


def _codes(df: DataFrame, code: str) -> DataFrame:
    return df.where(not_blank(code)).select(code).distinct().orderBy(code)


def filter_machines(results: DataFrame) -> DataFrame:
    return _codes_and_labels(results, "machine_code", "machine_name")


def filter_shifts(results: DataFrame) -> DataFrame:
    return _codes(results, "shift")


def filter_workshops(results: DataFrame) -> DataFrame:
    return _codes(results, "workshop")


def filter_articles(results: DataFrame, spec: FilterSpec = EVERYTHING) -> DataFrame:
    """Products made in the chosen workshop, on the chosen machines, with the chosen molds."""
    results = spec.apply(
        results, workshop="workshop", machines="machine_code", molds="mold_code")
    return _codes_and_labels(results, "product_code", "product_name")


def filter_molds(results: DataFrame, spec: FilterSpec = EVERYTHING) -> DataFrame:
    """Molds used in the chosen workshop and on the chosen machines."""
    results = spec.apply(results, workshop="workshop", machines="machine_code")
    return _codes_and_labels(results, "mold_code", "mold_name")
