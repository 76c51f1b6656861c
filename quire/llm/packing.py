"""Minimum-bin-slack packing of token ids into fixed windows.

Each document (its ids and one closing id) gives whole windows of ``capacity``
ids and one remainder.  A task keeps the multiset of remaining lengths as
counts per length (at most ``capacity`` numbers) and fills window after
window: the largest remaining length opens it, a bitset subset-sum dynamic
programme over the bounded counts finds the multiset closest to the space
left, and backtracking through the programme's layers gives the counts.  The
pattern found is repeated while the counts allow it.  Where no multiset closes
the window exactly, the largest remaining piece is cut to fill the slack and
its rest returns to the multiset, so every window of a task is full; what is
left at a task's end (less than one window) goes into windows whose lengths
are powers of two, which need no padding.

Packing is local to an input partition: no shuffle, no driver state, and all
pieces of a sequence are written by one task, next to each other.  A task
holds the ids of at most ``pool_tokens`` remainder ids plus one batch.
Sequence ids are (partition, number) in one long, so a retried task gives the
same ids and no two tasks share one.

Edge cases: null and empty text is the closing id alone (one piece of one id);
ties between equal lengths go to the earlier document; repeated rows are
packed once each; an empty table gives no pieces; the document key may be null,
repeated or of any type.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm import bpe
from quire.llm.memory import batchwise
from quire.session import ship_package


def closest_fill(counts: dict[int, int], lengths: list[int], space: int) -> dict[int, int]:
    """The multiset of ``lengths`` (sorted; at most ``counts[l]`` of each)
    whose sum comes closest to ``space`` from below: {length: how many}.

    ``reach`` is a bitset of reachable sums; one layer per length keeps the
    bitset before that length, for backtracking.  Stops at an exact fill.
    """
    mask, reach, layers = (1 << (space + 1)) - 1, 1, []
    for length in reversed(lengths[:bisect_right(lengths, space)]):
        layers.append((length, reach))
        left, step = min(counts[length], space // length), 1
        while left > 0:  # 1, 2, 4, ... copies: every number up to the bound
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> space & 1:
            break
    total, picked = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> total & 1:
            total -= length
            picked[length] = picked.get(length, 0) + 1
    return picked


class SlackPacker:
    """Fills windows from pieces offered one by one; see the module text.

    ``emit(piece, sequence, offset)`` receives every placed piece.  A piece is
    ``(owner, start, ids)``.
    """

    def __init__(self, capacity: int, emit, pool_tokens: int = 1 << 22):
        self.capacity, self.emit, self.pool_tokens = capacity, emit, pool_tokens
        self.pool: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.waiting = 0
        self.sequence = 0

    def offer(self, owner, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.capacity
        for at in range(0, full, self.capacity):
            self._place([(owner, at, ids[at:at + self.capacity])])
        if full < len(ids):
            self._add((owner, full, ids[full:].copy()))
        if self.waiting > self.pool_tokens:
            self._fill_while(self.pool_tokens // 4)

    def close(self) -> None:
        self._fill_while(self.capacity - 1)
        width = self.capacity
        while self.waiting:  # less than a window: powers of two, cut to fit
            while width > self.waiting:
                width //= 2
            window, space = [], width
            while space:
                piece = self._take(self.lengths[-1])
                if len(piece[2]) > space:
                    piece = self._cut(piece, space)
                window.append(piece)
                space -= len(piece[2])
            self._place(window)

    def _fill_while(self, floor: int) -> None:
        while self.waiting > floor and self.waiting >= self.capacity:
            seed = self.lengths[-1]
            self.counts[seed] -= 1
            pattern = closest_fill(self.counts, self.lengths, self.capacity - seed)
            self.counts[seed] += 1
            pattern[seed] = pattern.get(seed, 0) + 1
            slack = self.capacity - sum(n * c for n, c in pattern.items())
            for _ in range(1 if slack else min(self.counts[n] // c for n, c in pattern.items())):
                window = [self._take(n) for n in sorted(pattern, reverse=True)
                          for _ in range(pattern[n])]
                if slack:
                    window.append(self._cut(self._take(self.lengths[-1]), slack))
                self._place(window)

    def _add(self, piece, first: bool = False) -> None:
        n = len(piece[2])
        if not self.pool.get(n):
            self.pool.setdefault(n, deque())
            insort(self.lengths, n)
        (self.pool[n].appendleft if first else self.pool[n].append)(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.waiting += n

    def _take(self, n: int):
        piece = self.pool[n].popleft()
        self.counts[n] -= 1
        self.waiting -= n
        if not self.pool[n]:
            self.lengths.pop(bisect_left(self.lengths, n))
        return piece

    def _cut(self, piece, at: int):
        owner, start, ids = piece
        self._add((owner, start + at, ids[at:]), first=True)
        return owner, start, ids[:at]

    def _place(self, window) -> None:
        offset = 0
        for piece in window:
            self.emit(piece, self.sequence, offset)
            offset += len(piece[2])
        self.sequence += 1


def pack_tokens(docs: DataFrame, tokenizer_path: str | None = None, key: str = "doc_id",
                text: str = "text", capacity: int = 2048, closing_id: int = 1,
                pool_tokens: int = 1 << 22) -> DataFrame:
    """Pieces of all documents in gapless windows of ``capacity`` ids:
    ``key``, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(bpe.read_json(tokenizer_path or bpe.default_path()))
    key_type = docs.schema[key].dataType
    out = T.StructType([T.StructField("key", key_type)]
                       + [T.StructField(c, T.LongType()) for c in
                          ("start", "length", "doc_tokens", "sequence_id", "offset")]
                       + [T.StructField("ids", T.BinaryType())])

    def pack(batches):
        enc = bpe.encoder(shared.value)
        base = TaskContext.get().partitionId() << 33
        rows = []

        def emit(piece, sequence, offset):
            (k, n), start, ids = piece
            rows.append((k, start, len(ids), n, base + sequence, offset, ids.tobytes()))

        def flush():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_arrow)] + [pa.array(c, pa.int64()) for c in cols[1:6]]
                + [pa.array(cols[6], pa.binary())], out.fieldNames())

        packer, key_arrow = SlackPacker(capacity, emit, pool_tokens), None
        for b in batches:
            key_arrow = b.schema.field("key").type
            for k, t in zip(b.column("key"), b.column("text"), strict=True):
                ids = np.array(enc.ids(t.as_py() or "") + [closing_id], dtype="<u4")
                packer.offer((k.as_py(), len(ids)), ids)
                if len(rows) >= 1000:
                    yield flush()
        packer.close()
        if rows:
            yield flush()

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(batchwise(pack), out).withColumnRenamed("key", key))
