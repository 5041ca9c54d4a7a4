from pyspark.sql import Column, functions as F


def clean(value: str, width: int) -> Column:
    """Text cut to ``width`` characters, without surrounding blanks."""
    return F.trim(F.substring(F.col(value).cast("string"), 1, width))


def label_or_code(label: str, code: str, blank_is_missing: bool = False) -> Column:
    """The label, or the code where there is no label."""
    text = F.col(label)
    if blank_is_missing:
        text = F.nullif(F.trim(text), F.lit(""))
    return F.coalesce(text, F.col(code))
