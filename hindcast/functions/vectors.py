"""Unit vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def unit(vector: Column) -> Column:
    """L2-normalised copy; null for a zero vector."""
    norm = F.sqrt(dot(vector, vector))
    # Repeated, not inlined: a lambda would compute the length anew for every component.
    lengths = F.array_repeat(norm, F.size(vector))
    return F.when(norm > 0, F.zip_with(vector, lengths, lambda x, n: x.cast("double") / n))
