"""Arithmetic that Spark's ANSI mode refuses and SQL of other engines gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """a / b in floating point: infinite over 0, NaN for 0 over 0, null for nulls alone."""
    return F.when(b == 0, a.cast("double") * float("inf")).otherwise(F.try_divide(a.cast("double"), b.cast("double")))
