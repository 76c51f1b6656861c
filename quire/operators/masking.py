"""Masking schedule (M1) and dynamic token masking (M2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Schedule end points and the replacement split (80/10/10).
INITIAL_P = 0.30
FINAL_P = 0.15
TOTAL_EPOCHS = 50
REPLACE_MASK = 0.8
REPLACE_RANDOM = 0.5
IGNORE = -100


def mask_probability(epoch: Column, initial: float = INITIAL_P, final: float = FINAL_P,
                     total_epochs: int = TOTAL_EPOCHS) -> Column:
    """p0 - (p0 - p1) * e / max(1, E - 1), clamped to [0, 1]."""
    frac = epoch.cast("double") / F.lit(float(max(1, total_epochs - 1)))
    p = F.lit(initial) - (F.lit(initial) - F.lit(final)) * frac
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def mask_tokens(df: DataFrame, p, epoch, seed: int = 42, vocab_size: int = 30528,
                ids_col: str = "input_ids", key_col: str = "doc_id",
                n_specials: int = 5, mask_id: int = 4, method: str = "xxhash64") -> DataFrame:
    """M2: choose non-special positions with probability ``p``; of those 80 %
    become [MASK], 10 % a random id, 10 % stay; labels keep the original id
    at chosen positions and -100 elsewhere.

    Every draw is a hash of (seed, epoch, key, position, draw) -- no global
    RNG -- so the result is independent of partitioning and task retries.
    ``p`` and ``epoch`` may be columns (e.g. ``mask_probability(epoch)``).
    """
    from quire.functions.hashing import uniform

    pc = p if isinstance(p, Column) else F.lit(float(p))
    ec = epoch if isinstance(epoch, Column) else F.lit(int(epoch))
    key = F.col(key_col)

    def u(i, draw):
        return uniform(F.lit(seed), ec, key, i, F.lit(draw), method=method)

    def draw(t, i):
        chosen = (t >= F.lit(n_specials)) & (u(i, 0) < pc)
        return F.struct(t.alias("t"), i.alias("i"), chosen.alias("c"))

    def choose(s):
        t, i, chosen = s["t"], s["i"], s["c"]
        rand_id = F.floor(u(i, 3) * F.lit(vocab_size)).cast("int")
        new = (F.when(~chosen, t)
               .when(u(i, 1) < F.lit(REPLACE_MASK), F.lit(mask_id))
               .when(u(i, 2) < F.lit(REPLACE_RANDOM), rand_id)
               .otherwise(t))
        return F.struct(new.alias("id"), F.when(chosen, t).otherwise(F.lit(IGNORE)).alias("label"))

    # the selection draw is evaluated once per position; the replacement
    # draws only for chosen positions
    pairs = F.transform(F.transform(F.col(ids_col), draw), choose)
    return (df.withColumn("__m", pairs)
            .withColumn(ids_col, F.transform("__m", lambda s: s["id"]))
            .withColumn("labels", F.transform("__m", lambda s: s["label"]))
            .withColumn("epoch", ec)
            .drop("__m"))
