"""Masked-LM evaluation.

Input: one row per predicted position with a score vector and a label
(-100 = not masked).  Everything is a higher-order function over the score
array plus one grouped aggregate -- no explode, no shuffle of vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.arrays import label_rank, masked_lm_loss
from quire.operators.masking import IGNORE

# The k's the reference reports.
TOP_KS = (1, 5, 10, 25)


def masked_only(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P11."""
    return df.where(F.col(label_col) != F.lit(IGNORE))


def top_indices(scores, k: int):
    """Indices of the k largest scores (ties -> lower index first)."""
    s = F.col(scores) if isinstance(scores, str) else scores
    keyed = F.transform(s, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda t: t["i"])


def argmax(scores):
    return F.get(top_indices(scores, 1), 0)


def topk_report(df: DataFrame, scores: str = "scores", label: str = "label",
                group_cols=(), ks=TOP_KS, with_loss: bool = True) -> DataFrame:
    """A6 (+A7): accuracy@k and mean loss over masked positions, per group.  A
    label outside its score vector (or null scores) has no rank: it is counted
    in ``n_invalid`` and left out of the means."""
    m = masked_only(df, label).withColumn("__rank", label_rank(F.col(scores), F.col(label)))
    valid = F.col("__rank").isNotNull()
    aggs = [F.count(F.lit(1)).alias("n_masked"), F.count_if(~valid).alias("n_invalid")]
    aggs += [F.avg(F.when(valid, (F.col("__rank") < k).cast("double"))).alias(f"top{k}_accuracy") for k in ks]
    if with_loss:
        aggs.append(F.avg(F.when(valid, masked_lm_loss(F.col(scores), F.col(label)))).alias("mlm_loss"))
    return m.groupBy(*group_cols).agg(*aggs)
