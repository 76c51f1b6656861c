"""N-gram Jaccard self-join with a count-vector R-tree.

Two texts link when their sets of distinct ``k``-word shingles have
``100 * |A & B| >= percent * |A | B|``.  Texts with the same set are one
*class*; all work is on classes.

1. *Points.*  A class's shingles are hashed into groups; its point is the
   count per group.  The number of groups is a power of two between half
   of the set's size and the size, so points of comparable sets have the same or a neighbouring
   resolution, and a finer point folds exactly into a coarser one by adding.
   ``sum(min(a_g, b_g))`` bounds the overlap from above.
2. *Cells.*  Points lie sparsely in the space of single shingles, so the space
   is first split along its finest coordinates: linked sets of sizes n must
   share one of the first ``n - ceil(percent n / 100) + 1`` shingles in any
   common order.  The order puts widely shared shingles last, so a passage
   that many texts hold makes no cell unless a text has little else.  Cells of
   one class vanish; cells with the same members count once.
3. *Tree links.*  Inside a cell, each class is paired with its parent in a
   binary tree over the packing order (one pair per class, mostly the same in
   every cell); pairs met in several cells are verified exactly and
   contracted.  This merges groups of near copies without listing their pairs.
4. *R-tree join.*  In every cell that still holds more than one component, an
   R-tree over the members' points is descended with the summed-minima bound;
   surviving pairs across components are verified exactly: first a few partners
   per class, then, after contracting again, all pairs of the cells that had
   more.  So no link between different components is missed, none inside one is
   needed, and a large group of near copies does not list its pairs.

Nothing depends on the shared-shingle list but speed; it has a fixed maximum
size.  A cell larger than ``CELL`` members is dealt to salted blocks in step 3
and to pairs of blocks in step 4.

Edge cases: null, empty or word-less text has an empty set, links to nothing
and is its own component; a text of fewer than ``k`` words has its word
sequence as its one shingle; repeated rows and repeated keys are ordinary
copies; a component of null keys only has a null id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.components import components
from quire.llm.memory import batchwise, tablewise
from quire.llm.wordhash import NON_SPACE, mix, shingles, slices_by_bytes, words
from quire.session import materialize, ship_package, shuffle_partitions

FREQUENT = 8            # a shingle counted in so many texts goes last
FREQUENT_MOST = 1 << 20  # ... and at most so many do (8 MB broadcast)
CELL = 50_000           # members of a cell in one block
BUCKET = 1 << 19        # cell entries handled by one task
FANOUT = 16
_STEP = 2 << 20
_SLOTS = 1 << 24


# ---- sets and points -------------------------------------------------------

def _sets(batch, k: int):
    """(row, sorted shingle hashes) of every text of a batch."""
    for i, j in slices_by_bytes(batch.column("text"), _STEP):
        hashes, first = words(batch.column("text").slice(i, j - i), NON_SPACE)
        for r in range(j - i):
            yield i + r, shingles(hashes[first[r]:first[r + 1]], k)


def _uid(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def resolution(n: int) -> int:
    """Groups for a set of n shingles: a power of two between half of n and n,
    at least 16.  So fine a point tells sets apart whose similarity is a little
    too low, and its counts are small numbers."""
    return max(16, 1 << max(0, int(n - 1).bit_length() - 1))


def point(s: np.ndarray) -> np.ndarray:
    g = resolution(len(s))
    return np.bincount((s >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g)


def pack_point(counts: np.ndarray) -> bytes:
    """A point as bytes: a width mark, then its counts in the least width of a
    half, one or four bytes that holds them all."""
    top = int(counts.max()) if len(counts) else 0
    if top < 16:
        c = counts.astype(np.uint8)
        return b"\0" + (c[0::2] | (c[1::2] << np.uint8(4))).tobytes()
    return b"\1" + counts.astype(np.uint8).tobytes() if top < 256 else b"\2" + counts.astype("<u4").tobytes()


def unpack_point(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8, offset=1)
    if packed[0] == 0:
        out = np.empty(2 * len(raw), np.int32)
        out[0::2], out[1::2] = raw & 15, raw >> 4
        return out
    return (raw if packed[0] == 1 else raw.view("<u4")).astype(np.int32)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) at a coarser resolution: the sums of the merged groups."""
    return p.reshape(len(p), -1, groups).sum(1, dtype=np.int32) if p.shape[1] != groups else p


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _frequent(docs: DataFrame, k: int) -> DataFrame:
    """Shingles held by many texts, with lower bounds of their counts."""
    def repeated(sets):
        """(hash, count) of those met twice or more in a bounded number of sets."""
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        return h[n > 1], n[n > 1]

    def count(batches):
        for b in batches:
            met, sets, held = [], [], 0
            for _, s in _sets(b, k):
                sets.append(s)
                held += len(s)
                if held > _STEP // 4:
                    met.append(repeated(sets))
                    sets, held = [], 0
            if sets:
                met.append(repeated(sets))
            every = np.concatenate([h for h, _ in met]) if met else np.empty(0, np.uint64)
            h, of = np.unique(every, return_inverse=True)
            n = np.zeros(len(h), np.int64)
            np.add.at(n, of, np.concatenate([c for _, c in met]) if met else np.empty(0, np.int64))
            often = n > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

    return (docs.mapInArrow(batchwise(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST))


def _signatures(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """Per text: key, n, uid, point, prefix (uint64) -- the last two only on a
    class's first text in a batch."""
    out = T.StructType([T.StructField("key", docs.schema["key"].dataType),
                        T.StructField("n", T.IntegerType())]
                       + [T.StructField(c, T.BinaryType()) for c in ("uid", "point", "prefix")])

    def sign(batches):
        last = frequent.value[0]
        for b in batches:
            n, uid, points, prefix, seen = [], [], [], [], set()
            for _, s in _sets(b, k):
                u = _uid(s)
                n.append(len(s))
                uid.append(u)
                if u is None or u in seen:
                    points.append(None)
                    prefix.append(None)
                    continue
                seen.add(u)
                points.append(pack_point(point(s)))
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate((s[~late], s[late]))
                prefix.append(s[:prefix_size(len(s), percent)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n, pa.int32())]
                + [pa.array(c, pa.binary()) for c in (uid, points, prefix)], out.fieldNames())

    return docs.mapInArrow(batchwise(sign), out)


# ---- cells -----------------------------------------------------------------

def _deal(signed: DataFrame, buckets: int, frequent) -> DataFrame:
    """Cell entries, packed: one row per batch and bucket."""
    def deal(batches):
        hot, hot_n = frequent.value
        for b in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
            prefixes = b.column("prefix").to_pylist()
            uids = np.frombuffer(b"".join(b.column("uid").to_pylist()), dtype="V16")
            sizes = np.array(b.column("n").to_pylist(), dtype=np.uint32)
            h = np.frombuffer(b"".join(prefixes), dtype=np.uint64)
            owner = np.repeat(np.arange(len(prefixes)), [len(p) // 8 for p in prefixes])
            blocks = np.ones(len(h), np.uint64)
            if len(hot) and len(h):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                blocks = np.where(hot[at] == h, hot_n[at] // CELL + 1, 1).astype(np.uint64)
            salt = mix(np.frombuffer(uids.tobytes(), np.uint64)[::2][owner] ^ h) % blocks
            bucket = (mix(h + salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(k, order[edges[k]:edges[k + 1]]) for k in range(buckets)
                    if edges[k] < edges[k + 1]]
            cols = [[] for _ in range(7)]
            for k, at in rows:
                mine, local = np.unique(owner[at], return_inverse=True)
                for c, v in zip(cols, (k, uids[mine].tobytes(), sizes[mine].tobytes(), h[at].tobytes(),
                                       local.astype(np.uint32).tobytes(), salt[at].astype(np.uint32).tobytes(),
                                       blocks[at].astype(np.uint32).tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())]
                                             + [pa.array(c, pa.binary()) for c in cols[1:]],
                                             ["bucket", "uids", "sizes", "cells", "local", "salts", "blocks"])

    return signed.mapInArrow(batchwise(deal), "bucket int, uids binary, sizes binary, cells binary, "
                                   "local binary, salts binary, blocks binary")


_CELLS = "cell long, salt int, blocks int, uid binary, n int, other binary, weight int"


def _runs(*sorted_columns) -> np.ndarray:
    """Start of every run of equal rows, and the end."""
    n = len(sorted_columns[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.append(np.flatnonzero(new), n)


def tree_links(edge: np.ndarray, priority: np.ndarray):
    """(place, parent) of the binary tree that each run ``edge[i]:edge[i+1]`` of
    places forms under the places' priorities: a place's parent is the nearer
    in rank of the next greater priorities to its left and right.  Priorities
    belong to the classes, so a class mostly has the same parent in every cell,
    and a cell of m classes gives m - 1 links."""
    n = len(priority)
    run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    left = _next_greater(priority, run)
    right = n - 1 - _next_greater(priority[::-1], run[::-1])[::-1]
    left_p = np.where(left >= 0, priority[left], np.uint64(2**64 - 1))
    right_p = np.where(right < n, priority[np.minimum(right, n - 1)], np.uint64(2**64 - 1))
    parent = np.where(left_p <= right_p, left, right)
    child = np.flatnonzero((left >= 0) | (right < n))
    return child, parent[child]


def _next_greater(priority: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each place, the nearest one before it in its run with a greater
    priority, or -1: one walk with a stack."""
    out, stack, before = [], [], None
    values = priority.tolist()
    for i, (p, r) in enumerate(zip(values, run.tolist(), strict=True)):
        if r != before:
            stack, before = [], r
        while stack and values[stack[-1]] < p:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return np.array(out, np.int64)


def _read_cells(percent: int):
    """A bucket's cells of two classes or more: member rows (one cell for each
    distinct membership) and weighted tree-link rows."""
    def cells(table: pa.Table) -> pa.Table:
        def col(name, kind):
            return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        uids, sizes = col("uids", "V16"), col("sizes", np.uint32)
        base = np.cumsum([0] + [len(u) for u in uids])
        owner = np.concatenate([x + b for x, b in zip(col("local", np.uint32), base[:-1], strict=True)]).astype(np.int64)
        uids, sizes = np.concatenate(uids), np.concatenate(sizes).astype(np.int64)
        head = np.frombuffer(uids.tobytes(), np.uint64)[::2]
        _, first, same = np.unique(head, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((head[first], sizes[first]))] = np.arange(len(first))
        who = rank[same][owner]                     # number in packing order
        first = first[np.argsort(rank)]
        cell, salt = np.concatenate(col("cells", np.uint64)), np.concatenate(col("salts", np.uint32))
        blocks = np.concatenate(col("blocks", np.uint32))
        order = np.lexsort((who, salt, cell))
        cell, salt, blocks, who = cell[order], salt[order], blocks[order], who[order]
        once = _runs(cell, salt, who)[:-1]          # a class met in several batches
        cell, salt, blocks, who = cell[once], salt[once], blocks[once], who[once]
        edge = _runs(cell, salt)
        size = np.diff(edge)
        # members lie in size order: one whose neighbours are both too small or too
        # large for it has no partner in the cell (a split cell keeps every member,
        # its other blocks being elsewhere)
        if len(who):
            n_at = sizes[first][who]
            close = (cell[1:] == cell[:-1]) & (salt[1:] == salt[:-1]) & (n_at[:-1] * 100 >= n_at[1:] * percent)
            some = np.concatenate((close, [False])) | np.concatenate(([False], close)) | (blocks > 1)
            cell, salt, blocks, who = cell[some], salt[some], blocks[some], who[some]
            edge = _runs(cell, salt)
            size = np.diff(edge)
        live = np.flatnonzero((size > 1) | (blocks[edge[:-1]] > 1))
        if len(live):
            total = np.add.reduceat(mix(head[first][who]), edge[:-1])[live]
            whole = blocks[edge[live]] == 1
            _, pick, back, copies = np.unique(np.where(whole, total, mix(cell[edge[live]] + salt[edge[live]])),
                                              return_index=True, return_inverse=True, return_counts=True)
            live = live[pick]
        length = size[live]
        at = np.repeat(edge[live], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        place = who[at]
        child, parent = tree_links(np.concatenate(([0], np.cumsum(length))), mix(head[first][place])) if len(at) else (at, at)
        a = np.maximum(place[child], place[parent])   # the later in packing order
        b = np.minimum(place[child], place[parent])
        w = np.repeat(copies if len(live) else length, length)[child]
        n = sizes[first]
        fits = n[b] * 100 >= n[a] * percent          # a is the larger or equal one
        a, b, w = a[fits], b[fits], w[fits]
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        run = _runs(a, b)
        w = np.add.reduceat(w, run[:-1]) if len(a) else w
        a, b = a[run[:-1]], b[run[:-1]]

        def ids(which):
            return pa.array([uids[i].tobytes() for i in first[which]], pa.binary())
        none = len(a)
        members = who[at]
        return pa.table({
            "cell": pa.concat_arrays([pa.array(cell[at].view(np.int64)), pa.nulls(none, pa.int64())]),
            "salt": pa.concat_arrays([pa.array(salt[at].astype(np.int32)), pa.nulls(none, pa.int32())]),
            "blocks": pa.concat_arrays([pa.array(blocks[at].astype(np.int32)), pa.nulls(none, pa.int32())]),
            "uid": pa.concat_arrays([ids(members), ids(a)]),
            "n": pa.array(np.concatenate([n[members], n[a]]).astype(np.int32)),
            "other": pa.concat_arrays([pa.nulls(len(at), pa.binary()), ids(b)]),
            "weight": pa.concat_arrays([pa.nulls(len(at), pa.int32()), pa.array(w.astype(np.int32))])})

    return cells


# ---- the R-tree ------------------------------------------------------------

class CountRTree:
    """A packed R-tree over count vectors of one resolution, in size order.

    A node keeps the largest count per group and the size range below it.  A
    query meets a node only if the overlap its counts allow, the sum of
    ``min(q_g, high_g)``, could reach what the threshold asks of the smallest
    set in the node.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            high, low, top = self.levels[-1]
            at = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(top, at)))

    def _passes(self, q, nq, node, level):
        high, low, top = self.levels[level]
        p = self.percent
        ok = (top[node] * 100 >= nq * p) & (low[node] * p <= nq * 100)
        out = np.zeros(len(q), bool)
        for i in range(0, len(q), step := max(1, _STEP // (2 * high.shape[1]))):
            s = slice(i, i + step)
            keep = np.flatnonzero(ok[s])
            overlap = np.minimum(self.queries[q[s][keep]], high[node[s][keep]]).sum(1)
            # 100 |A&B| >= p (|A| + |B| - |A&B|)
            out[s][keep] = (100 + p) * overlap >= p * (nq[s][keep] + low[node[s][keep]])
        return out

    def join(self, queries: np.ndarray, sizes: np.ndarray):
        """(query, point) numbers of all pairs that pass the bound."""
        self.queries = queries
        q = np.repeat(np.arange(len(queries)), len(self.levels[-1][0]))
        node = np.tile(np.arange(len(self.levels[-1][0])), len(queries))
        for level in range(len(self.levels) - 1, -1, -1):
            ok = self._passes(q, sizes[q], node, level)
            q, node = q[ok], node[ok]
            if level:
                width = len(self.levels[level - 1][0])
                q = np.repeat(q, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, node = q[node < width], node[node < width]
        return q, node


def _near_pairs(tree: CountRTree, sizes: np.ndarray, label: np.ndarray, count: int):
    """Passing pairs of different labels among neighbours in packing order, for
    the first ``count`` points."""
    q, p = [], []
    for d in range(1, FANOUT + 1):
        i = np.arange(min(count, len(sizes) - d))
        i = i[label[i] != label[i + d]]
        i = i[tree._passes(i, sizes[i], i + d, 0)]
        q.append(i)
        p.append(i + d)
    return np.concatenate(q), np.concatenate(p)


def _at_most(q: np.ndarray, p: np.ndarray, limit: int):
    """At most ``limit`` pairs per query, and the queries that had more."""
    order = np.lexsort((p, q))
    q, p = q[order], p[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < limit], p[nth < limit], len(q) > 0 and bool((nth >= limit).any())


def cell_pairs(points: list, sizes: np.ndarray, label: np.ndarray, percent: int, limit: int | None = None):
    """(a, b, cut): pairs of different labels within one cell that pass the
    bound.  With ``limit``, at most so many partners per point, first from its
    neighbours in packing order; ``cut`` tells whether any were left out."""
    groups = np.array([len(p) for p in points])
    order = np.argsort(sizes, kind="stable")
    for g in np.unique(groups):
        mine = order[groups[order] == g]
        at = np.concatenate((mine, order[groups[order] == 2 * g]))
        coarse = [np.stack([points[i] for i in part]).astype(np.int32) for part in (mine, at[len(mine):]) if len(part)]
        every = np.concatenate([fold(c, g) for c in coarse])
        tree = CountRTree(every, sizes[at], percent)
        tree.queries = every
        todo, cut = np.arange(len(mine)), False
        if limit and len(at) > FANOUT:
            q, p, cut = _at_most(*_near_pairs(tree, sizes[at], label[at], len(mine)), limit)
            full = np.bincount(q, minlength=len(mine)) >= limit
            cut = cut or bool(full.any())
            yield at[q], at[p], cut
            todo = todo[~full]
        for i in range(0, len(todo), 256):
            mine_now = todo[i:i + 256]
            q, p = tree.join(every[mine_now], sizes[at][mine_now])
            q = mine_now[q]
            ok = (label[at[q]] != label[at[p]]) & (p > q)
            q, p, more = _at_most(q[ok], p[ok], limit) if limit else (q[ok], p[ok], False)
            yield at[q], at[p], more


def _small_cells(percent, edge, order, size, label, points):
    """Passing pairs of all cells no larger than a leaf, together."""
    length = np.diff(edge)
    pairs = [np.empty((0, 2), np.int64)]
    for m in range(2, FANOUT + 1):
        start = edge[:-1][length == m]
        i, j = np.triu_indices(m, 1)
        pairs.append(np.stack([order[start[:, None] + i].ravel(), order[start[:, None] + j].ravel()], 1))
    a, b = np.concatenate(pairs).T
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    ok = (label[a] != label[b]) & (size[a] * 100 >= size[b] * percent)
    a, b = a[ok], b[ok]
    groups = np.array([len(p) for p in points], dtype=np.int64)
    out = []
    for g in np.unique(groups[a]) if len(a) else ():
        x, y = a[groups[a] == g], b[groups[a] == g]
        for i in range(0, len(x), step := max(1, _STEP // (4 * g))):
            p = np.stack([points[k] for k in x[i:i + step]]).astype(np.int32)
            q = np.stack([points[k].reshape(-1, g).sum(0) for k in y[i:i + step]]).astype(np.int32)
            need = percent * (size[x[i:i + step]] + size[y[i:i + step]])
            ok = (100 + percent) * np.minimum(p, q).sum(1) >= need
            out.append(np.stack([x[i:i + step][ok], y[i:i + step][ok]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _join_cells(percent: int, limit: int | None):
    """A part's cells: pairs (a, b) across components that pass the bound; with
    ``limit``, also the cells (a row of their own) that had more."""
    def joined(table: pa.Table) -> pa.Table:
        uid, who = np.unique(np.array(table.column("uid").to_pylist(), dtype="V16"), return_inverse=True)
        _, label = np.unique(np.array(table.column("root").to_pylist(), dtype="V16"), return_inverse=True)
        points = [unpack_point(p) for p in table.column("point").to_pylist()]
        size = table.column("n").to_numpy().astype(np.int64)
        cell, lo, hi, salt = (table.column(c).to_numpy() for c in ("cell", "lo", "hi", "salt"))
        order = np.lexsort((hi, lo, cell))
        edge = _runs(cell[order], lo[order], hi[order])
        small = np.diff(edge) <= FANOUT
        # one block of a split cell may be small too, but must keep its blocks apart
        small &= (lo[order] == hi[order])[edge[:-1]] if len(order) else small
        found, cut_cells = [np.empty((0, 2), np.int64)], []
        keep = np.flatnonzero(small)
        if len(keep):
            lengths = np.diff(edge)[keep]
            rows = np.concatenate([order[edge[k]:edge[k + 1]] for k in keep])
            found.append(_small_cells(percent, np.concatenate(([0], np.cumsum(lengths))), rows, size, label, points))
        for k in np.flatnonzero(~small):
            at = order[edge[k]:edge[k + 1]]
            if len(np.unique(label[at])) < 2:
                continue
            for a, b, cut in cell_pairs([points[x] for x in at], size[at], label[at], percent, limit):
                a, b = at[a], at[b]
                across = (salt[a] != salt[b]) | (lo[a] == hi[a])
                found.append(np.stack([a[across], b[across]], 1))
                if cut:
                    cut_cells.append(cell[at[0]])
        a, b = who[np.concatenate(found)].T
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        more = np.unique(np.array(cut_cells, np.int64))
        ids = lambda x: pa.concat_arrays([pa.array([uid[i].tobytes() for i in x], pa.binary()),
                                          pa.nulls(len(more), pa.binary())])
        return pa.table({"a": ids(pair[:, 0]), "b": ids(pair[:, 1]),
                         "cell": pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(more)])})

    return joined


# ---- exact verification ----------------------------------------------------

def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, by their shingle sets.  Only texts whose class may
    be asked for are shingled into rows: a fixed-size bit map of the wanted
    ids' leading 24 bits filters them (false hits cost time alone)."""
    spark = docs.sparkSession
    pairs = materialize(pairs.distinct(), "pairs")
    slot = F.conv(F.hex(F.substring("uid", 1, 3)), 16, 10).cast("int")
    wanted = (pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).select(slot.alias("s"))
              .groupBy("s").agg(F.lit(1)).groupBy(F.shiftright("s", 12).alias("page"))
              .agg(F.collect_list(F.col("s").bitwiseAND(4095).cast("short")).alias("bits")))
    page = np.zeros(_SLOTS, bool)
    for r in wanted.toLocalIterator():
        page[(r["page"] << 12) + np.array(r["bits"], dtype=np.int64)] = True
    shared = spark.sparkContext.broadcast(np.packbits(page))

    def chosen(batches):
        bits, seen = np.unpackbits(shared.value).astype(bool), set()
        for b in batches:
            uid, sets = [], []
            for _, s in _sets(b, k):
                u = _uid(s)
                if u is not None and bits[int.from_bytes(u[:3], "big")] and u not in seen:
                    seen.add(u)
                    uid.append(u)
                    sets.append(s.view(np.int64))
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else [], pa.int64()))],
                ["uid", "s"])

    # both joins read the sets through the exchange of this grouping, made once
    sets = docs.mapInArrow(batchwise(chosen), "uid binary, s array<long>").groupBy("uid").agg(F.first("s").alias("s"))
    both = (pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b"))
    shared_n = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = both.where((100 + percent) * shared_n >= percent * (F.size("sa") + F.size("sb")))
    return materialize(links.select("a", "b"), "links")


def _follow(roots: DataFrame, later: DataFrame) -> DataFrame:
    """Nodes' roots after their roots have been joined."""
    nxt = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = roots.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return moved.unionByName(later.join(roots, "node", "left_anti"))


# ---- the operator ----------------------------------------------------------

def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per text: ``key``, n_shingles, uid (its class; null for an empty set),
    component_id (smallest key reachable by links)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hot = _frequent(docs, k).collect()
    hot_h = np.array([r.h for r in hot], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot_h)
    frequent = spark.sparkContext.broadcast(
        (hot_h[order], np.array([r.n for r in hot], dtype=np.int64)[order]))
    signed = materialize(_signatures(docs, k, percent, frequent), "signed")

    entries = signed.where("prefix is not null").agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(entries // BUCKET) + 1)
    dealt = _deal(signed.where("prefix is not null").select("uid", "n", "prefix"), buckets, frequent)
    cells = materialize(dealt.groupBy("bucket").applyInArrow(tablewise(_read_cells(percent)), _CELLS), "cells")
    members = cells.where("cell is not null").select("cell", "salt", "blocks", "uid")

    near = (cells.where("cell is null").groupBy(F.col("uid").alias("a"), F.col("other").alias("b"))
            .agg(F.sum("weight").alias("w")).where("w > 2").select("a", "b"))
    links = _verify(near, docs, k, percent)
    roots = materialize(components(links), "roots")

    points = materialize(signed.where("point is not null").groupBy("uid").agg(
        F.first("n").alias("n"), F.first("point").alias("point")), "points")
    # first with few partners per class, which joins what is left of the groups
    # of near copies; then every pair of the cells that had more
    for limit in (3, None):
        labelled = (members.join(roots.withColumnRenamed("node", "uid"), "uid", "left")
                    .withColumn("root", F.coalesce("root", "uid")))
        mixed = labelled.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        rest = materialize(labelled.join(mixed.select("cell", "x"), "cell"), "mixed")
        rows = rest.count()
        if not rows:
            break
        parts = max(shuffle_partitions(spark), rows // 20_000 + 1)
        found = (rest.join(points, "uid")
                 .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("cell", F.least("salt", "with").alias("lo"), F.greatest("salt", "with").alias("hi"),
                         "salt", "uid", "root", "n", "point", "x")
                 # cells of one group meet in a few parts, where a pair is listed once
                 .withColumn("part", F.pmod(F.xxhash64("x", F.pmod("cell", F.lit(4)), "lo", "hi"), F.lit(parts)))
                 .drop("x")
                 .groupBy("part").applyInArrow(tablewise(_join_cells(percent, limit)), "a binary, b binary, cell long"))
        found = materialize(found, "found")
        # the links between components, as links between their roots
        of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        late = (_verify(found.where("cell is null").select("a", "b"), docs, k, percent)
                .join(of("a"), "a", "left").join(of("b"), "b", "left")
                .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
        roots = materialize(_follow(roots, materialize(components(late), "roots")), "roots")
        members = members.join(found.where("cell is not null").select("cell").distinct(), "cell", "left_semi")

    least = (signed.where("uid is not null").groupBy("uid").agg(F.min("key").alias("least"))
             .join(roots.withColumnRenamed("node", "uid"), "uid", "left")
             .withColumn("root", F.coalesce("root", "uid")))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(named, "root").select("uid", "component_id")
    return (signed.select("key", "n", "uid").join(of, "uid", "left")
            .select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), "uid",
                    F.when(F.col("uid").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")))
