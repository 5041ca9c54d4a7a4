"""Column helpers; all of them are compositions of built-in functions."""

from presswork.functions.numbers import or_zero, percent, round_to, share
from presswork.functions.text import clean, label_or_code
from presswork.functions.times import (
    as_instant, epoch_seconds, from_instant, hours_between, minute_diff,
)

__all__ = [
    "as_instant", "clean", "epoch_seconds", "from_instant", "hours_between", "label_or_code",
    "minute_diff", "or_zero", "percent", "round_to", "share",
]
