"""Membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_membership(df: DataFrame, ids: DataFrame, key: str = "doc_id",
                    name: str = "is_member") -> DataFrame:
    """Boolean flag ``key in ids`` (duplicate ids count once).  Whether the
    ids are broadcast is left to adaptive execution, which knows their bytes;
    a null key is no member."""
    q = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    return (df.join(q, key, "left")
            .withColumn(name, F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit"))
