"""Input tables as the operators take them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from presswork.functions import clean
from presswork.schemas import SCHEMAS


def canonical(df: DataFrame, name: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with the column names, types and clean texts of canonical table ``name``.

    ``columns`` maps canonical names to those of the source where they differ.
    Codes and labels are cut to their width and trimmed here, once: operators
    compare plain columns, and their filters reach the scan if the result is
    stored.
    """
    columns = columns or {}

    def column(field: T.StructField):
        source = columns.get(field.name, field.name)
        if isinstance(field.dataType, T.StringType):
            return clean(source, field.metadata["width"]).alias(field.name)
        return F.col(source).cast(field.dataType).alias(field.name)

    return df.select(*map(column, SCHEMAS[name]))


class Tables(Mapping[str, DataFrame]):
    """The canonical tables, read when first asked for.

    ``read`` returns the frame of a table by its canonical name, for example
    ``lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")``,
    ``spark.table``, or a ``spark.read.jdbc`` call with a partition column.
    """

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self._read = read
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def raw(cls, read: Callable[[str], DataFrame],
            columns: Mapping[str, Mapping[str, str]] | None = None) -> Tables:
        """Tables from source frames; ``columns`` holds a column mapping per table."""
        columns = columns or {}
        return cls(lambda name: canonical(read(name), name, columns.get(name)))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._frames:
            self._frames[name] = self._read(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self[name]
        raise AttributeError(name)

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)
