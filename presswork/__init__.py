"""Shop-floor analytics for moulding presses, as lazy DataFrame operators on Spark."""

from presswork.filters import FilterSpec
from presswork.sources.tables import Tables

__all__ = ["FilterSpec", "Tables"]
