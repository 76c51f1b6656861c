"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores every training token's posting.  The index is split by
documents into segments of bounded text; a segment's row holds its sorted term
hashes, the bounds of each term's posting list, and the lists themselves
(ascending word positions in the segment), plus its documents' word counts.
Building is one narrow pass (no shuffle); Parquet column pruning lets a reader
take the document columns alone.

``search`` answers test windows against every segment.  Per segment, a
window's terms are ordered by their local posting counts; the rarest list gives
the candidate starts, and each next list, shifted by its offset, is intersected
with them until all terms agree.  A window with a term the segment lacks costs
nothing.  Test texts travel in blocks of bounded size (the stated query set),
one pass over the index each.

``proximity`` returns anchors of the rarest term that have every other term of
the window within a given number of words, in the same document.

Words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``,
identified by 64-bit hashes.  Edge cases: null or empty documents have no
words and no hits; null or empty items have no window; an item of fewer words
than a window is one window; repeated items and documents each count, item ids
are counted once; a null item id marks words but names no item; either table
may be empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.memory import batchwise
from quire.llm.wordhash import ALNUM, slices_by_bytes, words
from quire.session import materialize, scratch_path, ship_package

SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
_CANDIDATES = 1 << 21


# ---- the index ------------------------------------------------------------

def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: segment, keys[], doc_words[], terms, bounds,
    postings (binary: uint64, uint32, uint32)."""
    ship_package(docs.sparkSession)
    schema = T.StructType([
        T.StructField("segment", T.LongType()),
        T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
        T.StructField("doc_words", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.BinaryType()) for c in ("terms", "bounds", "postings")]])

    def index(batches):
        base, n = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for i, j in slices_by_bytes(b.column("text"), SEGMENT_BYTES):
                part = b.slice(i, j - i)
                hashes, first = words(part.column("text"), ALNUM)
                order = np.argsort(hashes, kind="stable").astype(np.uint32)
                ranked = hashes[order]
                edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))
                                      ) if len(ranked) else np.empty(0, np.int64)
                keys = part.column("key")
                yield pa.RecordBatch.from_arrays([
                    pa.array([base + n], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()),
                                             pa.array(np.diff(first).astype(np.int32))),
                    pa.array([ranked[edge].tobytes()], pa.binary()),
                    pa.array([np.append(edge, len(ranked)).astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([order.tobytes()], pa.binary())], schema.fieldNames())
                n += 1

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(batchwise(index), schema))


class Segment:
    """Posting lists of one index row, ready for lookups."""

    def __init__(self, doc_words, terms: bytes, bounds: bytes, postings: bytes):
        self.ends = np.cumsum(np.asarray(doc_words, dtype=np.int64))
        self.terms = np.frombuffer(terms, np.uint64)
        self.bounds = np.frombuffer(bounds, np.uint32).astype(np.int64)
        self.postings = np.frombuffer(postings, np.uint32)

    def lists(self, vocabulary: np.ndarray):
        """(start, length) of each vocabulary term's list; length 0 if absent."""
        if not len(self.terms):
            return np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        found = self.terms[at] == vocabulary
        start = self.bounds[at]
        return start, np.where(found, self.bounds[at + 1] - start, 0)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")


def _expand(start: np.ndarray, length: np.ndarray):
    """Row number and element index of every element of the given ranges."""
    row = np.repeat(np.arange(len(start)), length)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return row, np.repeat(start, length) + inner


class Windows:
    """Distinct windows of one block of test texts.

    ``terms[w, j]`` is the vocabulary number of window w's j-th word, -1 past
    the end of a short one; ``items`` lists the (window, item) pairs.
    """

    def __init__(self, texts: list, width: int):
        hashes, first = words(pa.array(texts, pa.string()), ALNUM)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        rows, owner = [], []
        for i in range(len(texts)):
            w = number[first[i]:first[i + 1]]
            if 0 < len(w) < width:
                rows.append(np.pad(w, (0, width - len(w)), constant_values=-1)[None])
            elif len(w):
                rows.append(np.lib.stride_tricks.sliding_window_view(w, width))
            owner.append(np.full(len(rows[-1]) if len(w) else 0, i))
        every = np.concatenate(rows) if rows else np.empty((0, width), np.int64)
        self.terms, of = np.unique(every.astype(np.int64), axis=0, return_inverse=True)
        self.items = np.unique(np.stack([of.ravel(), np.concatenate(owner)], 1).astype(np.int64),
                               axis=0) if len(every) else np.empty((0, 2), np.int64)
        self.sizes = (self.terms >= 0).sum(1)

    def rarest_first(self, counts: np.ndarray):
        """Per window: its word offsets, rarest local term first; and whether
        every term occurs in the segment."""
        n = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        return np.argsort(n, axis=1, kind="stable"), (n > 0).all(1)


def _keys(seg: Segment, start, length):
    """Sorted (term number << 32 | position) of all listed postings."""
    row, at = _expand(start, length)
    return (row.astype(np.uint64) << np.uint64(32)) | seg.postings[at]


def _groups(lengths: np.ndarray):
    """Runs of windows whose candidates together stay near a bound."""
    total, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _CANDIDATES, "right")))
        yield i, j
        i = j


def phrase_matches(seg: Segment, win: Windows):
    """(window, start position) of every exact occurrence in the segment."""
    start, length = seg.lists(win.vocabulary)
    order, alive = win.rarest_first(length)
    alive = np.flatnonzero(alive)
    found = [np.empty((2, 0), np.int64)]
    if not len(alive):
        return found[0]
    keys = _keys(seg, start, length)
    rarest = win.terms[alive, order[alive, 0]]
    for i, j in _groups(length[rarest]):
        w, t = alive[i:j], rarest[i:j]
        row, at = _expand(start[t], length[t])
        w = w[row]
        begin = seg.postings[at].astype(np.int64) - order[w, 0]
        doc = seg.doc_of(np.maximum(begin, 0))
        ok = (begin >= 0) & (doc == seg.doc_of(begin + win.sizes[w] - 1))
        w, begin = w[ok], begin[ok]
        for r in range(1, win.terms.shape[1]):  # next-rarest lists, offset-adjusted
            offset = order[w, r]
            term = win.terms[w, offset]
            want = (np.maximum(term, 0).astype(np.uint64) << np.uint64(32)) | (
                begin + offset).astype(np.uint64)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = (keys[at] == want) | (term < 0)
            w, begin = w[ok], begin[ok]
        found.append(np.stack([w, begin]))
    return np.concatenate(found, axis=1)


def proximity_matches(seg: Segment, win: Windows, within: int):
    """(window, anchor position): the rarest term's postings that have every
    other term of the window at most ``within`` words away in the same text."""
    start, length = seg.lists(win.vocabulary)
    order, alive = win.rarest_first(length)
    alive = np.flatnonzero(alive)
    found = [np.empty((2, 0), np.int64)]
    if not len(alive):
        return found[0]
    keys = _keys(seg, start, length)
    rarest = win.terms[alive, order[alive, 0]]
    for i, j in _groups(length[rarest]):
        row, at = _expand(start[rarest[i:j]], length[rarest[i:j]])
        w, anchor = alive[i:j][row], seg.postings[at].astype(np.int64)
        for r in range(1, win.terms.shape[1]):
            term = win.terms[w, order[w, r]]
            doc = seg.doc_of(anchor)
            low = np.maximum(anchor - within, np.where(doc > 0, seg.ends[doc - 1], 0))
            high = np.minimum(anchor + within, seg.ends[doc] - 1)
            base = np.maximum(term, 0).astype(np.uint64) << np.uint64(32)
            at = np.minimum(np.searchsorted(keys, base | low.astype(np.uint64)), len(keys) - 1)
            ok = ((keys[at] >= (base | low.astype(np.uint64)))
                  & (keys[at] <= (base | high.astype(np.uint64)))) | (term < 0)
            w, anchor = w[ok], anchor[ok]
        found.append(np.stack([w, anchor]))
    return np.concatenate(found, axis=1)


# ---- queries over the index ------------------------------------------------

def _blocks(items: DataFrame, key: str, text: str):
    """The test texts in blocks of bounded bytes, as (ids, texts)."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(key).cast("string").alias("i"), F.col(text).alias("t"))
    for r in rows.where(F.col("t").isNotNull()).toLocalIterator():
        if texts and size + len(r.t) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
    if texts:
        yield ids, texts


_HITS = "segment long, ord int, items array<string>, spans array<struct<start:int,stop:int>>"


def _doc_rows(segment: int, seg: Segment, ids: list, win: Windows, matches: np.ndarray):
    """Per hit document: its items and the merged word spans that are hit."""
    w, begin = matches
    stop = begin + win.sizes[w]
    order = np.argsort(begin, kind="stable")
    w, begin, stop = w[order], begin[order], stop[order]
    doc = seg.doc_of(begin)
    first = np.searchsorted(win.items[:, 0], np.arange(len(win.terms) + 1))
    for d in np.unique(doc):
        lo, hi = np.searchsorted(doc, [d, d + 1])
        origin = seg.ends[d - 1] if d else 0
        reach = np.maximum.accumulate(stop[lo:hi])
        new = np.concatenate(([True], begin[lo + 1:hi] > reach[:-1]))
        edges = np.flatnonzero(new)
        spans = [(int(a - origin), int(b - origin)) for a, b in zip(
            begin[lo:hi][edges], reach[np.append(edges[1:], hi - lo) - 1], strict=True)]
        named = {ids[i] for x in np.unique(w[lo:hi])
                 for i in win.items[first[x]:first[x + 1], 1]} - {None}
        yield segment, int(d), sorted(named), [{"start": a, "stop": b} for a, b in spans]


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text",
           width: int = 10, within: int | None = None) -> DataFrame:
    """Rows (segment, ord, items, spans) of documents with a match, one per
    block of test texts.  ``within`` asks for proximity instead of phrases;
    spans are then the anchors."""
    spark = index.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "hits")
    spark.createDataFrame([], _HITS).write.mode("append").parquet(path)
    for ids, texts in _blocks(items, key, text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def match(batches, shared=shared):
            names, block = shared.value
            win = Windows(block, width)
            for b in batches:
                for i in range(b.num_rows):  # one segment at a time as Python objects
                    r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    seg = Segment(r["doc_words"], r["terms"], r["bounds"], r["postings"])
                    hits = (phrase_matches(seg, win) if within is None
                            else proximity_matches(seg, win, within))
                    rows = list(_doc_rows(r["segment"], seg, names, win, hits))
                    cols = list(zip(*rows, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                        pa.array(cols[2], pa.list_(pa.string())),
                        pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()),
                                                              ("stop", pa.int32())])))],
                        ["segment", "ord", "items", "spans"])

        (index.select("segment", "doc_words", "terms", "bounds", "postings")
         .mapInArrow(batchwise(match), _HITS).write.mode("append").parquet(path))
        shared.unpersist()
    return spark.read.schema(_HITS).parquet(path)


def _covered(spans):
    """Words in the union of spans (possibly overlapping across blocks)."""
    return F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"], s["start"]))).alias("n"),
            F.greatest(a["stop"], s["stop"]).alias("stop")),
        lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text",
                  width: int = 10) -> DataFrame:
    """Per document: ``key``, n_words, n_hit, items (sorted item ids), spans
    (hit word ranges), contaminated."""
    index = materialize(build_index(docs, key, text), "index")
    hits = (search(index, items, item_key, item_text, width)
            .groupBy("segment", "ord")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                 F.flatten(F.collect_list("spans")).alias("spans"))
            .withColumn("n_hit", _covered(F.col("spans")).cast("long")))
    rows = index.select("segment", F.posexplode(F.arrays_zip("keys", "doc_words")).alias("ord", "d"))
    none = F.array().cast("array<string>")
    return (rows.join(hits, ["segment", "ord"], "left")
            .select(F.col("d.keys").alias(key), F.col("d.doc_words").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", none).alias("items"), "spans",
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
