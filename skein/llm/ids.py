"""Integer ids on their way through pandas, which turns a column that holds a null into floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns that stand for one id.
SCHEMA = "missing boolean, id long"


def apart(name: str) -> list[Column]:
    """An id as two columns without nulls."""
    value = F.col(name).cast("long")
    return [value.isNull().alias("missing"), F.coalesce(value, F.lit(0).cast("long")).alias("id")]


def together(name: str) -> Column:
    """The id again, from the two columns."""
    return F.when(~F.col("missing"), F.col("id")).alias(name)
