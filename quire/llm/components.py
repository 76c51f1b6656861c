"""Connected components of a link table.

Links are read in blocks of about ``BLOCK``; a task contracts its block to a
forest (every node to the smallest node it reaches in the block) by hooking and
pointer jumping in numpy.  If there was more than one block, alternating star
contraction (large-star, small-star) over the forests' links finishes the work
in DataFrames: each round points every node at the smallest neighbour it
knows, so a chain of any length shrinks in a logarithmic number of rounds.
Smallest neighbours come from a partial aggregate joined back, so a root with a
third of all nodes for neighbours is split like any skewed join.  Rounds go on
until one changes nothing (if none does, the job fails).  They are written to the
shared scratch folder, which cuts the lineage; no links or components reach the
driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import materialize, ship_package

BLOCK = 1 << 20


def _forest(batches):
    """One block's links -> (node, smallest node reached), without roots."""
    a, b = [], []
    for x in batches:
        a.append(x.column("a"))
        b.append(x.column("b"))
    if not a or not sum(map(len, a)):
        return
    ends = pa.chunked_array(a + b).combine_chunks().dictionary_encode()
    names = ends.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    at = rank[ends.indices.to_numpy()]
    u, v = at[:len(at) // 2], at[len(at) // 2:]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(names)))
    place = pa.array(order)
    yield pa.RecordBatch.from_arrays([ends.dictionary.take(place.take(pa.array(child))),
                                      ends.dictionary.take(place.take(pa.array(root[child])))], ["a", "b"])


def _with_smallest(links: DataFrame) -> DataFrame:
    """``links`` with m, the smallest b of the row's a."""
    return links.join(links.groupBy("a").agg(F.min("b").alias("m")), "a")


def _contract(e: DataFrame, rounds: int) -> DataFrame:
    """Star contraction of links (a > b) until every node points at its root."""
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_with_smallest(both).where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct())
        large = materialize(large, "links")
        small = (_with_smallest(large)
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct("a", F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a > b").distinct())
        e = materialize(small, "links")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return e
        last = mark
    raise RuntimeError(f"components not settled after {rounds} rounds")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of
    the component.  Links may repeat, point both ways or be loops; null ends
    are dropped."""
    ship_package(links.sparkSession)
    e = materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
                    .distinct(), "links")
    blocks = e.count() // BLOCK + 1
    e = materialize(e.coalesce(blocks).mapInArrow(_forest, e.schema), "links")
    if blocks > 1:  # one block's forest is the answer
        e = _contract(e, rounds)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
