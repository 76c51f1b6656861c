"""Upsample quality rows -- member rows get ``int(factor - 1)`` extra
adjacent copies (never fewer than zero); nothing is removed.

Copies are produced in place with ``explode(sequence(0, extra))``, so the
only shuffle is the membership join (broadcast when the id set is proven
small).  ``copy`` orders the duplicates right after their original.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quire.operators.joins import with_membership


def extra_copies(factor: float) -> int:
    """Python ``int(factor - 1)`` (truncation toward zero), floored at 0."""
    return max(0, math.trunc(factor - 1))


def upsample(df: DataFrame, quality_ids: DataFrame, factor: float = 2.0,
             key: str = "doc_id") -> DataFrame:
    k = extra_copies(factor)
    flagged = with_membership(df, quality_ids, key, "__q")
    n = F.when(F.col("__q"), F.lit(k)).otherwise(F.lit(0)).cast("long")
    return flagged.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n))).drop("__q")
