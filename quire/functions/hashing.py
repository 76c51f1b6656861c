"""Deterministic per-row uniforms.

No global RNG: a uniform in [0, 1) is a hash of its coordinates, so results
survive repartitioning, retries and lost executors.  ``md5`` is portable (the
same value is computable in DuckDB SQL); ``xxhash64`` is the fast default.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0
TWO_53 = 9007199254740992.0


def uniform(*parts, method: str = "xxhash64") -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if method == "md5":
        key = F.concat_ws(":", *[c.cast("string") for c in cols])
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)
    if method == "xxhash64":
        h = F.xxhash64(*cols)
        return F.pmod(h, F.lit(int(TWO_53))).cast("double") / F.lit(TWO_53)
    raise ValueError(f"unknown hash method {method!r}")
