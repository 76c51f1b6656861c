"""Source divergence audit over run-length columns.

Each language keeps the terms found in enough of its documents.  A *group* is a
(language, source) that occurs; the groups' counts over the kept terms are
columns of one table per language, compared pair by pair.

* *Reorder.*  Terms are numbered so that equal counts lie together: by the
  number of sources that have the term, a hash of which sources those are, the
  total count, a hash of all counts, and the term.  Terms that only some sources
  have are then neighbours (the others' columns hold one run of zeros there), and
  terms with equal counts everywhere are next to each other.
* *Encode.*  The numbers are cut into segments of ``segment`` terms.  A group's
  column in a segment is a list of runs (start, count), zeros included.
* *Intersect.*  Two columns are constant between the union of their run starts,
  so f is evaluated once per such stretch and multiplied by its length.  A task
  holds one segment of at most two ``tile``s of sources, and sums over segments
  are partial sums, so neither a language nor a source that holds most rows
  meets in one task.

With p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)).
All of it is integers: the division is a long division in base 1,000, so that no
product leaves 64 bits.

Terms are counted inside Arrow batches (a task keeps at most ``HELD`` distinct
terms before it passes its counts on), then summed with map-side partial sums; a
kept term's counts travel as one row, an entry for each source that has it.

Edge cases: null text, language and source are ''; a language without kept terms
(V = 0) has value 0 for every pair and no terms; a source alone in its language
has no pairs; equal values rank by item in UTF-8 order; repeated rows count
each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators.ordering import with_positions
from quire.session import materialize, ship_package

HELD = 500_000          # distinct terms a task holds before it passes its counts on
PIECE = 1 << 20         # bytes of a text that are split at once
SEGMENT = 1 << 14       # terms in a segment
TILE = 32               # sources in a tile, about
SCALE = 1_000_000_000   # fixed by the definition of p

# lower-case A-Z; bytes outside [A-Za-z\x80-\xFF] separate terms.  Every byte of
# a character above 0x7F is above 0x7F, so bytes can stand for characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes):
    """The terms of a text, in lists of about ``PIECE`` bytes."""
    folded = text.translate(_FOLD)
    i, n = 0, len(folded)
    while i < n:
        j = n if n - i <= PIECE else folded.find(b" ", i + PIECE)
        j = n if j < 0 else j
        yield folded[i:j].split()
        i = j


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in
    each group; every group has a row with term '' and no occurrences."""
    ship_package(docs.sparkSession)
    empty = F.lit("")
    d = docs.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"),
                    F.coalesce(text, empty).alias("text"))

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (g, s), (n, in_docs) in held.items():
                words = [b"", *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(words)), pa.array([s] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                     pa.array([n[w] for w in words], pa.int64()), pa.array([in_docs[w] for w in words], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            for g, s, t in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                n, in_docs = held.setdefault((g, s), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in terms(t.as_py()):
                    n.update(words)
                    seen.update(words)
                in_docs.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    counted = d.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), exactly."""
    q, r = np.divmod(count + 2, total)
    for _ in range(3):
        digit, r = np.divmod(r * 1000, total)
        q = q * 1000 + digit
    return q + 1


def runs_of(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of a column of ``length`` that holds
    ``counts`` at ``places`` (ascending) and zero elsewhere."""
    column = np.zeros(length, np.int64)
    column[places] = counts
    starts = np.flatnonzero(np.concatenate(([length > 0], column[1:] != column[:-1])))
    return starts, column[starts]


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The sum of f over two columns of runs (starts, p)."""
    if length == 0:
        return 0
    starts = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], starts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], starts, side="right") - 1]
    f = (p - q) ** 2 // (p + q)
    return int((f * np.diff(starts, append=length)).sum())


def share(count: Column, total: Column) -> Column:
    """``shares`` as a column: decimals hold the product, the division is whole."""
    ten_up = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", ten_up, total.cast("decimal(20,0)"))


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


class Audit:
    """The counts of a table of documents, their kept terms in run order, and
    the runs.  ``least`` documents of a language make a term kept."""

    def __init__(self, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                 least: int = 10, segment: int = SEGMENT, tile: int = TILE):
        self.segment, self.tile = segment, tile
        # a row per kept term, with its counts; and one per language (term '') with its sources
        counts = term_counts(docs, lang, source, text).groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("sources"),
            F.bit_xor(F.xxhash64("source")).alias("which"), F.bit_xor(F.xxhash64("source", "n")).alias("alike"),
            F.collect_list(F.struct("source", "n")).alias("cells"))
        counts = materialize(counts.where((F.col("docs") >= least) | (F.col("term") == "")).drop("docs"), "terms")
        placed = with_positions(counts.where("term <> ''"), ["lang", "sources", "which", "lang_n", "alike", "term"], name="place")
        #: V and N of each language, and where its terms begin
        langs = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"),
                                           F.min("place").alias("first"))
        self.rows = placed.select("lang", "term", "lang_n", "place", F.inline("cells"))
        totals = self.rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term = ''").select("lang", F.explode("cells.source").alias("source"))
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = materialize(groups.select(
            "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("first", F.lit(0)).alias("first")), "groups")

    def columns(self) -> DataFrame:
        """(lang, source, segment, length, total, starts, counts): each group's
        runs, a row per segment of its language."""
        g = self.groups.withColumn("total", F.col("total") + 2 * F.col("v"))
        pieces = g.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("v") / self.segment) - 1, F.lit(0)))))
        place = F.col("place") - F.col("first")
        cells = (self.rows.join(self.groups.select("lang", "source", "first"), ["lang", "source"])
                 .groupBy("lang", "source", F.floor(place / self.segment).alias("segment"))
                 .agg(F.collect_list(F.struct((place % self.segment).alias("at"), "n")).alias("cells")))
        length = F.least(F.lit(self.segment), F.col("v") - F.col("segment") * self.segment).cast("long")
        d = pieces.join(cells, ["lang", "source", "segment"], "left").select(
            "lang", "source", "segment", length.alias("length"), "total", F.sort_array("cells").alias("cells"))

        def encode(batches):
            for b in batches:
                starts, values = [], []
                for cells, length in zip(b.column("cells"), b.column("length").to_pylist(), strict=True):
                    inner = cells.values
                    at = inner.field("at").to_numpy() if inner is not None else np.empty(0, np.int64)
                    n = inner.field("n").to_numpy() if inner is not None else np.empty(0, np.int64)
                    s, v = runs_of(at, n, length)
                    starts.append(s)
                    values.append(v)
                head = [b.column(c) for c in ("lang", "source", "segment", "length", "total")]
                yield pa.RecordBatch.from_arrays([*head, pa.array(starts, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))],
                                                 ["lang", "source", "segment", "length", "total", "starts", "counts"])

        return d.mapInArrow(encode, "lang string, source string, segment long, length long, total long, "
                                    "starts array<long>, counts array<long>")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of every two sources of a language."""
        # a language's sources are dealt into tiles; two tiles meet in one group
        tiles = self.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / self.tile).alias("tiles"))
        col = self.columns().join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
        col = col.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        met = col.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

        def compare(table: pa.Table) -> pa.Table:
            rows = table.select(["lang", "source", "length", "total", "tile", "low", "high"]).to_pylist()
            lists = [[x.values.to_numpy() for chunk in table.column(c).chunks for x in chunk] for c in ("starts", "counts")]
            columns = [(s, shares(c, max(1, r["total"]))) for s, c, r in zip(*lists, rows, strict=True)]
            head, pairs = rows[0], []
            for i, a in enumerate(columns):
                for j in range(i + 1, len(columns)):
                    if head["low"] == head["high"] or rows[i]["tile"] != rows[j]["tile"]:
                        f = divergence(a, columns[j], head["length"])
                        pairs += [(rows[i]["source"], rows[j]["source"], f), (rows[j]["source"], rows[i]["source"], f)]
            return pa.table({"lang": pa.array([head["lang"]] * len(pairs), pa.string()),
                             "source": pa.array([x[0] for x in pairs], pa.string()),
                             "item": pa.array([x[1] for x in pairs], pa.string()),
                             "value": pa.array([x[2] for x in pairs], pa.int64())})

        partial = met.groupBy("lang", "segment", "low", "high").applyInArrow(
            compare, "lang string, source string, item string, value long")
        return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def typical_terms(self, most: int = 10) -> DataFrame:
        """(lang, source, item, value, rank) of the terms a group uses more than
        its language does."""
        p, q = F.col("p"), F.col("q")
        r = self.rows.join(self.groups, ["lang", "source"]).select(
            "lang", "source", F.col("term").alias("item"),
            share(F.col("n"), F.col("total") + 2 * F.col("v")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v")).alias("q"))
        r = r.where(p > q).select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
        return ranked(r, most)


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 10,
                      most: int = 10, segment: int = SEGMENT, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a group
    with each other source of its language, part ``term`` lists its ``most``
    most typical terms."""
    audit = Audit(docs, lang, source, text, least, segment, tile)
    out = ["lang", "source", "part", "item", "value", "rank"]
    pair = ranked(audit.pairs()).withColumn("part", F.lit("pair")).select(*out)
    return pair.unionByName(audit.typical_terms(most).withColumn("part", F.lit("term")).select(*out))
