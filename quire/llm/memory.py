"""Memory of Python workers.

Spark reuses a worker for tasks of other queries, and what Arrow and the C
allocator keep for reuse stays with it: over the stages of one session every
worker grows to the largest of its tasks.  Functions wrapped here hand the
unused part back when their task's data ends.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return free memory of this process to the operating system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def batchwise(function):
    """A ``mapInArrow`` function that gives its memory back at its end."""
    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()
    return run


def tablewise(function):
    """An ``applyInArrow`` function of one table that gives its memory back."""
    @wraps(function)
    def run(table):
        try:
            return function(table)
        finally:
            give_back()
    return run
