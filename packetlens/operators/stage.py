"""Boundaries between steps of long expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sealed(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed at this point, without a shuffle.

    The optimizer substitutes a projection's expressions into what stands above
    it, filters too; over a chain of steps that each use their columns several
    times such an expression grows exponentially. A generated row stops that.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
