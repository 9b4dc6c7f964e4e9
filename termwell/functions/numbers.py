"""Number helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounded half up after cutting the noise of floating-point arithmetic."""
    return F.round(value.cast("decimal(20,10)"), digits).cast("double")
