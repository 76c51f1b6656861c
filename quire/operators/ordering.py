"""Global order without a single-partition window.

``with_positions`` numbers rows 0..n-1 by order keys.  The input is evaluated
once: it is written to the scratch folder, and the count, the sample of the
range partitioner and the shuffle all read that table.  Spark's range
partitioner deals the rows to ordered partitions, each sorts its own, and the
result is written with each row's place in its partition (the low 33 bits of
``monotonically_increasing_id``).  One count per partition gives the offsets --
a table of as many rows as partitions -- and a position is offset + place.
Everything after the write reads the same files, so every branch of a plan and
every retried task sees one order, ties included.

Rows of equal keys are told apart by the place they were written at, which is
part of the range keys: a key that a third of the rows share is dealt to a third
of the ranges.  The data moves through one shuffle and no window; a range
partition is one task's sort, so their number follows the data
(``ROWS_PER_PARTITION``).

``number_in_input_order`` numbers rows as they were read.  Readers number the
rows of a file or split, so one count per split, summed up in input order, places
every row: no sort and no shuffle of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import materialize, shuffle_partitions

ROWS_PER_PARTITION = 1_000_000
BROADCAST_SPLITS = 1 << 17   # more splits than this (some 20 MB) are joined by a shuffle
_PLACE_BITS = 33


def with_positions(df: DataFrame, order_cols: list[str], name: str = "pos",
                   n_partitions: int | None = None, where: Column | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order
    (nulls first).  Equal keys get adjacent positions in an order fixed once,
    when the input is written; add columns to settle it.  Only rows of ``where``
    are numbered: it is tested on the written input, while Spark would move a
    filter of ``df`` below its columns and compute those it names twice."""
    spark = df.sparkSession
    written = materialize(df.withColumn("__tie", F.monotonically_increasing_id()), "positions-input")
    if where is not None:
        written = written.where(where)
    n = n_partitions or max(shuffle_partitions(spark), -(-written.count() // ROWS_PER_PARTITION))
    keys = [*order_cols, "__tie"]
    ranged = (written.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")
              .withColumn("__place", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "positions")
    part = F.shiftright("__place", _PLACE_BITS)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(  # one row per range partition
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    place = F.col("__place").bitwiseAND((1 << _PLACE_BITS) - 1)
    return (ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn(name, (F.col("__off") + place).cast("long"))
            .drop("__part", "__place", "__off"))


def number_in_input_order(df: DataFrame, split_cols: list[str], row_col: str, name: str = "pos") -> DataFrame:
    """Add ``name`` = 0-based position of each row, splits (the values of
    ``split_cols``) in order, rows of a split by ``row_col``, their number in it.

    The numbers of a split must be without gaps, from wherever they begin: a row
    number in a file, or ``monotonically_increasing_id`` after the last filter
    where a split is whole in one task.  The input is evaluated once, while it is
    written; a split whose numbers have gaps fails the job."""
    written = materialize(df, "input-order")
    splits = written.groupBy(*split_cols).agg(F.count(F.lit(1)).alias("__n"), F.min(row_col).alias("__lo"), F.max(row_col).alias("__hi"))
    before = Window.orderBy(*split_cols).rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    gaps = F.col("__hi") - F.col("__lo") + 1 != F.col("__n")
    splits = splits.select(
        *[F.col(c).alias(f"__{c}") for c in split_cols],
        F.when(gaps, F.raise_error(F.lit("the row numbers of a split have gaps")).cast("long")).otherwise(
            F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__lo")).alias("__shift"))
    splits = materialize(splits, "input-splits")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in split_cols])
    return (written.join(splits, on).withColumn(name, (F.col(row_col) + F.col("__shift")).cast("long"))
            .drop("__shift", *[f"__{c}" for c in split_cols]))


def take_prefix(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """First n rows in position order (W2): a pushed-down filter, not a limit."""
    return df.where(F.col(pos_col) < F.lit(n))


def prefix_series(df: DataFrame, step: int, value_cols: list[str] | None = None,
                  pos_col: str = "pos") -> DataFrame:
    """For every prefix size n = step, 2*step, ... (and the full size): the row
    count and the sum of ``value_cols`` over rows with pos < n.  One aggregate
    to per-step buckets, then a running sum over the (small) bucket table."""
    value_cols = value_cols or []
    bucket = F.floor(F.col(pos_col) / F.lit(step)).cast("long")
    per = df.groupBy(bucket.alias("step_idx")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(c) for c in value_cols])
    w = Window.orderBy("step_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = per.select(
        ((F.col("step_idx") + 1) * F.lit(step)).alias("prefix_size"),
        F.sum("rows").over(w).alias("n_rows"),
        *[F.sum(c).over(w).alias(f"sum_{c}") for c in value_cols])
    return out


def assign_batches(df: DataFrame, batch_size: int = 64, pos_col: str = "pos",
                   name: str = "batch_id") -> DataFrame:
    """Contiguous slices of ``batch_size`` rows (W3); the last may be short."""
    return df.withColumn(name, F.floor(F.col(pos_col) / F.lit(batch_size)).cast("long"))


def epoch_order(df: DataFrame, epoch: int, seed: int = 42, key_col: str = "doc_id",
                batch_size: int = 128, method: str = "md5") -> DataFrame:
    """Epoch shuffle (W6): a hash of (seed, epoch, key) orders the rows,
    positions are assigned with ``with_positions``, batches are contiguous."""
    from quire.functions.hashing import uniform
    keyed = df.withColumn("shuffle_key", uniform(seed, epoch, F.col(key_col), method=method))
    out = with_positions(keyed, ["shuffle_key", key_col], name="pos")
    return assign_batches(out.withColumn("epoch", F.lit(epoch)), batch_size)


def epoch_positions(df: DataFrame, n: int, epoch: int, seed: int = 42, number_col: str = "pos", batch_size: int = 128,
                    method: str = "xxhash64") -> DataFrame:
    """Epoch shuffle (W6) of a table whose rows are numbered 0..n-1 in
    ``number_col``: ``shuffled`` and ``batch_id`` come from the number alone, by a
    keyed permutation, so an epoch costs no sort and no shuffle."""
    from quire.functions.permute import permuted
    out = df.withColumn("epoch", F.lit(epoch)).withColumn("shuffled", permuted(F.col(number_col), n, seed, epoch, method=method))
    return assign_batches(out, batch_size, "shuffled")
