"""G1: order-preserving next-fit packing of texts into long contexts.

Semantics: walk texts in order keeping ``cur`` = total length of the open
bin where every member counts its length + 1 (a joining space).  A text
joins when ``cur + len(text) <= T``; otherwise the bin closes and the text
opens a new one.  An over-long text therefore sits alone and whole.  A bin's
text is its members joined by single spaces, stripped.  Null texts are
dropped first.  With ``scope`` columns, bins never span two scope groups.

Distributed exactly, with no group larger than one block:

1. texts are ordered and numbered 0..n-1 once, with their text
   (``with_positions``: one range shuffle, written to the scratch folder); every
   later step uses the number, never the user's keys, so null, equal or hashed
   keys lose and repeat nothing.  Equal keys keep the order of that write;
2. blocks of B >= T+2 consecutive numbers (lengths only), each with a halo copy
   of the next block's first T+1 rows (a bin starting in a block ends within
   T+1 rows, so ``next(i)`` is visible inside block+halo);
3. pass 1 (``applyInPandas`` per block): ``next(i)`` by binary search on
   prefix sums; the block exit and bin count for every possible entry in
   the block's first T+1 rows, by pointer doubling; returned run-length
   encoded (chains merge fast, so this is a few rows per block);
4. the maps are composed in block order as a tree (``fold.block_states``): each
   block learns its entry and the number of its first bin, nothing passes
   through the driver;
5. pass 2: walk the chain from the true entry, number bins globally;
6. text rows and bin ids meet by range of numbers, one shuffle of the text.  A
   range assembles its bins in place; the rows of the few bins that straddle two
   ranges are known from the numbers alone and are grouped by bin instead.
   Ranges are sized from the total characters.  Bins are bounded (<= T
   characters or one over-long text).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.text import py_strip
from quire.operators.fold import FAN, block_states
from quire.operators.ordering import with_positions
from quire.session import materialize, ship_package, shuffle_partitions

DEFAULT_BLOCK_ROWS = 1 << 20
RANGE_CHARS = 128 << 20     # characters of text one assembling task holds


def _next_pointers(L: np.ndarray, gkey, T_: int, nb: int) -> np.ndarray:
    """next(i) for local rows i < nb, with m = len(L) meaning 'past the end'."""
    m = len(L)
    S = np.zeros(m + 1, dtype=np.int64)
    np.cumsum(L.astype(np.int64) + 1, out=S[1:])
    idx = np.arange(nb, dtype=np.int64)
    k = np.searchsorted(S, S[:nb] + T_ + 1, side="right") - 1
    nxt = np.minimum(np.maximum(idx + 1, k), m)
    if gkey is not None and m > 1:
        g = np.asarray(gkey)
        starts = np.flatnonzero(g[1:] != g[:-1]) + 1
        if len(starts):
            j = np.searchsorted(starts, idx, side="right")
            gnext = np.where(j < len(starts), starts[np.minimum(j, len(starts) - 1)], m)
            nxt = np.minimum(nxt, gnext)
    return nxt


def _split_block(pdf: pd.DataFrame):
    pdf = pdf.sort_values("__seq", kind="stable")
    halo = pdf["halo"].to_numpy()
    nb = int((~halo).sum())
    gkey = pdf["__g"].to_numpy() if "__g" in pdf.columns else None
    return pdf, nb, gkey


def _summary_fn(T_: int):
    """A block's map: runs of (lo, hi, exit, bins) over its possible entries."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, nb, gkey = _split_block(pdf)
        L = pdf["L"].to_numpy()
        m = len(L)
        s_b = int(pdf["__seq"].iloc[0])
        nxt = _next_pointers(L, gkey, T_, nb)
        P = np.arange(m + 1, dtype=np.int64)
        P[:nb] = nxt
        C = np.zeros(m + 1, dtype=np.int64)
        C[:nb] = 1
        while (P[:nb] < nb).any():
            C = C + C[P]
            P = P[P]
        e = min(T_ + 1, nb)
        lo = np.arange(s_b, s_b + e)
        runs = _merged(np.stack([lo, lo, P[:e] + s_b, C[:e]], axis=1))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "map": [runs.ravel().tolist()]})
    return fn


def _merged(runs: np.ndarray) -> np.ndarray:
    """Neighbouring runs of equal exit and bins as one."""
    first = np.concatenate(([True], (runs[1:, 2:] != runs[:-1, 2:]).any(axis=1)))
    out = runs[first].copy()
    out[:, 1] = runs[np.concatenate((first[1:], [True])), 1]
    return out


def _through(runs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exit, bins) of entries; one behind the last run passes by (the bin before
    a short last block may hold all of it)."""
    at = np.minimum(np.searchsorted(runs[:, 1], entry), len(runs) - 1)
    inside = (runs[at, 0] <= entry) & (entry <= runs[at, 1])
    if not (inside | (entry > runs[-1, 1])).all():
        raise AssertionError("an entry is not covered by the block's map")
    return np.where(inside, runs[at, 2], entry), np.where(inside, runs[at, 3], 0)


def _compose(a: list[int], b: list[int]) -> list[int]:
    """The map of block a, then b."""
    x, y = (np.array(m, np.int64).reshape(-1, 4) for m in (a, b))
    out, bins = _through(y, x[:, 2])
    return _merged(np.stack([x[:, 0], x[:, 1], out, x[:, 3] + bins], axis=1)).ravel().tolist()


def _enter(m: list[int], state: list[int]) -> list[int]:
    """(entry, bins before) of the next block."""
    out, bins = _through(np.array(m, np.int64).reshape(-1, 4), np.array(state[:1], np.int64))
    return [int(out[0]), state[1] + int(bins[0])]


def _assign_fn(T_: int):
    def fn(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf, nb, gkey = _split_block(pdf)
        s_b = int(pdf["__seq"].iloc[0])
        entry, before = (int(x) for x in state["state"].iloc[0])
        nxt = _next_pointers(pdf["L"].to_numpy(), gkey, T_, nb)
        marks = np.zeros(nb, dtype=np.int64)
        i = entry - s_b
        while i < nb:
            marks[i] = 1
            i = int(nxt[i])
        return pd.DataFrame({"__seq": pdf["__seq"].to_numpy()[:nb], "bin_id": np.cumsum(marks) - 1 + before})
    return fn


def _bins_of(numbered: DataFrame, n: int, T_: int, scope: list[str], block_rows: int | None, fan: int) -> DataFrame:
    """(__seq, bin_id) of numbered texts (``__seq``, ``L``, scope columns)."""
    B = max(T_ + 2, int(block_rows or DEFAULT_BLOCK_ROWS))
    pos = F.col("__seq")
    cols = ["__seq", "L"] + (["__g"] if scope else [])
    base = numbered.withColumn("__g", F.to_json(F.struct(*scope), {"ignoreNullFields": "false"})) if scope else numbered
    main = base.select(*cols, F.floor(pos / B).cast("long").alias("block"), F.lit(False).alias("halo"))
    halo = base.where((pos >= B) & (F.pmod(pos, F.lit(B)) <= T_)).select(
        *cols, (F.floor(pos / B) - 1).cast("long").alias("block"), F.lit(True).alias("halo"))
    blocks = main.unionByName(halo)
    maps = materialize(blocks.groupBy("block").applyInPandas(_summary_fn(T_), "block long, map array<long>"), "pack-maps")
    states = block_states(maps, (n + B - 1) // B, [0, 0], _compose, _enter, fan)
    return blocks.groupBy("block").cogroup(states.groupBy("block")).applyInPandas(_assign_fn(T_), "__seq long, bin_id long")


def _bin_text(pieces):
    return F.array_join(F.transform(F.sort_array(pieces), lambda p: p["__t"]), " ")


def pack_contexts(df: DataFrame, max_length: int = 8192, order_cols=("pos",), scope=None,
                  text_col: str = "clinical_text", block_rows: int | None = None,
                  range_rows: int | None = None, fan: int = FAN) -> DataFrame:
    """Packed bins: (bin_id, scope..., n_docs, first_pos, text).  Texts are taken
    in ``(scope..., order_cols...)`` order, nulls first; a null scope is a group
    of its own.  ``range_rows`` fixes the texts per assembling range (by default
    sized from the total characters), ``fan`` the blocks folded in one group."""
    spark = df.sparkSession
    ship_package(spark)
    scope, T_ = list(scope or []), int(max_length)
    keys = scope + [c for c in order_cols if c not in scope]
    texts = df.select(*keys, F.col(text_col).alias("__t"), F.length(text_col).cast("long").alias("L"))
    numbered = with_positions(texts, keys, name="__seq", where=F.col("__t").isNotNull())
    n, chars = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum("L"), F.lit(0))).first()
    out = ["bin_id", *scope, "n_docs", "first_pos"]
    if n == 0:
        return numbered.select(F.col("__seq").alias("bin_id"), *scope, F.col("__seq").alias("n_docs"),
                               F.col("__seq").alias("first_pos"), F.col("__t").alias("text"))
    tasks = max(shuffle_partitions(spark), chars // RANGE_CHARS + 1)
    rows = range_rows or max(1, n // (4 * tasks))
    rng = F.floor(F.col("__seq") / rows).cast("long").alias("__r")
    bins = _bins_of(numbered.select("__seq", "L", *scope), n, T_, scope, block_rows, fan)
    ends = Window.partitionBy("bin_id")
    bins = materialize(bins.withColumn("__spans", F.floor(F.min("__seq").over(ends) / rows)
                                       != F.floor(F.max("__seq").over(ends) / rows)), "pack-bins")
    t = numbered.select("__seq", "__t", *scope, rng).repartition(tasks, "__r")
    b = bins.select("__seq", "bin_id", "__spans", rng).repartition(tasks, "__r")
    placed = t.join(b, ["__r", "__seq"])

    def assemble(rows_: DataFrame, by: list[str]) -> DataFrame:
        return rows_.groupBy(*by).agg(
            *[F.first(c).alias(c) for c in scope], F.count(F.lit(1)).alias("n_docs"), F.min("__seq").alias("first_pos"),
            py_strip(_bin_text(F.collect_list(F.struct("__seq", "__t")))).alias("text"))

    whole = assemble(placed.where(~F.col("__spans")), ["__r", "bin_id"])
    split = assemble(placed.where("__spans"), ["bin_id"])
    return whole.select(*out, "text").unionByName(split.select(*out, "text"))
