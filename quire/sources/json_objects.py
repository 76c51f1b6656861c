"""Files that are one JSON object ``{key: {field: text}}``, read in splits.

Such a file may be a single line, so it is scanned in chunks that end at a
closing brace (``lineSep``); text may hold braces too.  Whether a brace closes
an entry depends on two things: whether it is inside a string, and how deep it
is.  Per split, one row says for both ways of entering it (outside or inside a
string) how it ends and how much deeper; these maps are composed in file order
(``operators.fold``), so every split knows its string state and depth, and a
second scan cuts out the entries.  Entries that straddle splits are put together
from their pieces.  No file is ever one value.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.operators.fold import block_states
from quire.session import materialize, ship_package
from quire.sources.csv_rows import INSIDE, OUTSIDE, compose_splits, enter_split

BROADCAST_SPLITS = 1 << 19   # narrow rows; more splits than this fail (64 TB of 128 MB splits)
_REST = r'(?:[^"\\]++|\\.)*+"'
_STRING, _STRING_END = re.compile('"' + _REST, re.S), re.compile(_REST, re.S)


def after_chunk(chunk: str, state: int) -> tuple[int, int]:
    """The string state behind a chunk's closing brace, and how much deeper it is."""
    if state == INSIDE:
        m = _STRING_END.match(chunk)
        if m is None:
            return INSIDE, 0
        chunk = chunk[m.end():]
    bare = _STRING.sub("", chunk) if '"' in chunk else chunk
    opened = bare.find('"')
    if opened >= 0:
        return INSIDE, bare.count("{", 0, opened)
    return OUTSIDE, bare.count("{") - 1


def _chunks(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("value").cast("binary").alias("chunk"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"))


def _entries_of(chunks: DataFrame) -> DataFrame:
    """(file, block, exit, deeper, exit1, deeper1) of every split."""
    schema = pa.schema([("file", pa.string()), *[(c, pa.int64()) for c in ("block", "exit", "deeper", "exit1", "deeper1")]])

    def scan(batches):
        at, ends, out = None, [], []
        for b in batches:
            for value, *split in zip(b.column("chunk"), b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
                if at != split:
                    if at is not None:
                        out.append((*at, *ends[0], *ends[1]))
                    at, ends = split, [(OUTSIDE, 0), (INSIDE, 0)]
                chunk = value.as_py().decode("utf-8", "replace")
                steps = {s: after_chunk(chunk, s) for s in {e[0] for e in ends}}
                ends = [(steps[s][0], depth + steps[s][1]) for s, depth in ends]
        if at is not None:
            out.append((*at, *ends[0], *ends[1]))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return chunks.mapInArrow(scan, "file string, block long, exit long, deeper long, exit1 long, deeper1 long")


def _cut(chunks: DataFrame) -> DataFrame:
    """(file, block, part, text): whole entries (part 0), and pieces: the end of an
    entry that began before the split (1) and the beginning of one that goes on
    behind it (2; 3 if the split is all inside one entry)."""
    def rows(batches):
        at, held, state, depth, fresh = None, [], OUTSIDE, 0, True

        def left():
            return [(*at, 2 if fresh else 3, "".join(held))] if held else []

        for b in batches:
            out = []
            for i, (value, *split) in enumerate(zip(b.column("chunk"), b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True)):
                if at != split:
                    out += left() if at is not None else []
                    at, held = split, []
                    state, depth = b.column("state")[i].as_py(), b.column("depth")[i].as_py()
                    fresh = state == OUTSIDE and depth <= 1
                chunk = value.as_py().decode("utf-8", "replace")
                if depth == 0 and state == OUTSIDE and not held:  # the outer object begins
                    before, brace, behind = chunk.partition("{")
                    if brace and not before.strip("\ufeff \t\r\n"):
                        chunk, depth = behind, 1
                state, deeper = after_chunk(chunk, state)
                depth += deeper
                held.append(chunk + "}")
                if state == OUTSIDE and depth <= 1:
                    text = "".join(held)
                    if depth <= 0:  # the outer object ends; what is before its brace may be entries without braces
                        text = text[:-1]
                    if text.strip(" \t\r\n,"):
                        out.append((*at, 0 if fresh else 1, text))
                    held, fresh = [], True
            if out:
                yield _batch(out)
        if at is not None and left():
            yield _batch(left())

    return chunks.mapInArrow(rows, "file string, block long, part int, text string")


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["file", "block", "part", "text"])


def object_entries(spark: SparkSession, path) -> DataFrame:
    """(file, json): the entries of each file's object, each as an object of its
    own: ``{key: value}`` (a few keys where values are not objects)."""
    ship_package(spark)
    chunks = _chunks(spark, path)
    s = materialize(_entries_of(chunks), "json-splits")
    order = Window.orderBy("file", "block")  # one narrow row per split
    near = s.withColumn("n", F.row_number().over(order).cast("long") - 1).withColumn(
        "first", ~F.lag("file").over(order).eqNullSafe(F.col("file")))
    n = s.count()
    if n > BROADCAST_SPLITS:
        raise ValueError(f"{n} splits in one read; read the files in parts")
    maps = near.select(F.col("n").alias("block"), F.array(F.col("first").cast("long"), "exit", "deeper", "exit1", "deeper1").alias("map"))
    states = block_states(maps, n, [OUTSIDE, 0], compose_splits, enter_split).select(F.col("block").alias("n"), F.col("state").alias("s"))
    entered = near.join(states, "n").select("file", "block", *[
        F.when(F.col("first"), 0).otherwise(F.col("s")[i]).alias(c) for i, c in enumerate(("state", "depth"))])
    cut = materialize(_cut(chunks.join(F.broadcast(entered), ["file", "block"])), "json-entries")
    # the pieces of an entry: one beginning, then whole splits, then an end
    pieces = cut.where("part > 0")
    place = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    owner = pieces.select("file", "block", "part", F.sum((F.col("part") == 2).cast("int")).over(place).alias("entry"))
    joined = (pieces.join(owner, ["file", "block", "part"]).groupBy("file", "entry")
              .agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
              .select("file", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    whole = cut.where("part = 0").select("file", "text").unionByName(joined)
    entry = F.regexp_replace("text", r"^[\s,]+", "")
    return whole.select("file", F.concat(F.lit("{"), entry, F.lit("}")).alias("json"))
