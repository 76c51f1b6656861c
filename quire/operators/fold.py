"""Ordered fold of block maps, as a tree in Spark.

A table cut into blocks 0..n-1 often needs, at every block, what all the blocks
before it come to: an entry place, a state, a cost vector.  Each block is summed
up by a small map; maps compose.  ``block_states`` composes them in groups of
``fan`` neighbours, level by level (one row a group), walks the last level from
the start state, and hands the states down again: every block of a group is
walked from the state its parent received.  No group holds more than ``fan``
rows, nothing passes through the driver, and each level above the blocks is
written, so a lost executor repeats one level's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.session import materialize, ship_package

FAN = 1024

Map = list[int]
State = list[int]


def block_states(maps: DataFrame, n_blocks: int, start: State, compose: Callable[[Map, Map], Map],
                 apply: Callable[[Map, State], State], fan: int = FAN) -> DataFrame:
    """(block, state): the state on entering each block; write it if it is used
    more than once.

    ``maps`` has one row (``block`` long, ``map`` array<long>) for each of the
    blocks 0..n_blocks-1.  ``compose(a, b)`` is the map of a, then b;
    ``apply(m, s)`` the state after a block entered in ``s``."""
    ship_package(maps.sparkSession)
    if fan < 2:
        raise ValueError("fan must be 2 or more")

    def squeeze(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        all_of = [int(x) for x in pdf["map"].iloc[0]]
        for m in pdf["map"].iloc[1:]:
            all_of = compose(all_of, [int(x) for x in m])
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0]) // fan], "map": [all_of]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, states = [int(x) for x in pdf["state"].iloc[0]], []
        for m in pdf["map"]:
            states.append(state)
            state = apply([int(x) for x in m], state)
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "state": states})

    up = F.floor(F.col("block") / fan).cast("long")
    levels, n = [maps.select("block", "map")], n_blocks
    while n > fan:
        squeezed = levels[-1].groupBy(up.alias("parent")).applyInPandas(squeeze, "block long, map array<long>")
        levels.append(materialize(squeezed, "fold-maps"))
        n = -(-n // fan)
    states = None
    for level in reversed(levels):
        below = level.withColumn("parent", up)
        if states is None:  # at most ``fan`` rows, all of parent 0
            below = below.withColumn("state", F.array(*[F.lit(int(x)).cast("long") for x in start]))
        else:
            below = below.join(states.select(F.col("block").alias("parent"), "state"), "parent")
        states = below.groupBy("parent").applyInPandas(walk, "block long, state array<long>")
        if level is not levels[0]:
            states = materialize(states, "fold-states")
    return states
