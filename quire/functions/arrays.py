"""Array (score-vector) functions, built on higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_rank(scores, label) -> Column:
    """0-based rank of ``scores[label]``: strictly larger scores, plus equal
    scores at a lower index.  Null when the label is outside the vector."""
    s, lab = _c(scores), _c(label)
    target = F.get(s, lab)
    ranked = F.size(F.filter(
        s, lambda x, i: (x > target) | ((x == target) & (i < lab))))
    return F.when((lab >= 0) & (lab < F.size(s)), ranked)


def topk_hit(scores, label, k: int) -> Column:
    """1.0 when the label is among the top-k scores, else 0.0."""
    return F.when(label_rank(scores, label) < k, 1.0).otherwise(0.0)


def masked_lm_loss(scores, label) -> Column:
    """Cross-entropy of one position: logsumexp(scores) - scores[label],
    shifted by the max score so large logits do not overflow."""
    s, lab = _c(scores), _c(label)
    m = F.array_max(s).cast("double")
    sumexp = F.aggregate(s, F.lit(0.0).cast("double"),
                         lambda acc, x: acc + F.exp(x.cast("double") - m))
    return m + F.log(sumexp) - F.get(s, lab).cast("double")


def pad_right(arr, length, pad_value) -> Column:
    """Truncate or right-pad ``arr`` to exactly ``length`` elements."""
    a = _c(arr)
    n = length if isinstance(length, Column) else F.lit(length)
    fill = F.array_repeat(F.lit(pad_value), F.greatest(n - F.size(a), F.lit(0)))
    return F.slice(F.concat(a, fill), 1, n)


def cosine(a, b) -> Column:
    """Cosine similarity of two equal-length float arrays."""
    x, y = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                      F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    nx = F.aggregate(x, F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v)
    ny = F.aggregate(y, F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v)
    return dot / (F.sqrt(nx) * F.sqrt(ny))
