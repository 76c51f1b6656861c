"""A keyed permutation of 0..n-1, row by row.

A Feistel network over pairs (left < a, right < b) with a * b >= n: each round
adds a hash of one half to the other, which can be undone, so the network permutes
0..ab-1.  A number sent to n or beyond is sent on until it lands below n (cycle
walking), which permutes 0..n-1.  With a = ceil(sqrt(n)) fewer than a numbers lie
beyond n, so a walk of ``WALK`` steps always ends for n <= ``WALK``^2, and else is
longer with probability below n^(-WALK / 2); such a row fails the job.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, functions as F

ROUNDS = 8
WALK = 16


def sides(n: int) -> tuple[int, int]:
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _hash(parts: list[Column], method: str) -> Column:
    if method == "md5":
        return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(*parts), F.lit(1 << 32))
    raise ValueError(f"unknown hash method {method!r}")


def permuted(x: Column, n: int, *key, method: str = "xxhash64") -> Column:
    """The place in 0..n-1 that the permutation named by ``key`` gives ``x``."""
    a, b = sides(n)
    names = [F.lit(k) for k in key]

    def network(x: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            left, right = F.call_function("div", s, F.lit(b).cast("long")), s % b
            on_left = ((left + _hash([*names, k, right], method) % a) % a) * b + right
            on_right = left * b + (right + _hash([*names, k, left], method) % b) % b
            return F.when(k % 2 == 0, on_left).otherwise(on_right)
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, one)

    start = x.cast("long")
    done = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(start),
                       lambda s, _: F.when(s < n, s).otherwise(network(s)))
    return F.when((start < 0) | (start >= n), F.raise_error(F.lit("a number outside 0..n-1")).cast("long")).when(
        done < n, done).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
