"""CSV files read row by row under their own header, in splits.

Files of one source may order, add or lack columns, so a scan does not bind
them all by position to one header.  Quoted cells hold newlines, so a line is
not a record; yet an uncompressed file is read in many tasks:

1. *Summary.*  The files are scanned as lines.  At a line's start a record
   either begins or goes on inside a quoted cell; per split, one row says for
   both cases how the split ends and how many records begin in it (and keeps the
   lines of a record that the split's edges cut, up to ``KEEP`` characters).
2. *Fold.*  The splits' maps are composed in file order (``operators.fold``):
   every split learns how it is entered and the number of its first record.
3. *Rows.*  The lines are scanned again; complete records are cut into cells,
   and records that straddle splits are put together from the kept lines (longer
   ones are read again from their splits only).

A gzip file is one split by nature.  Every row has its file and its number in
the file -- the identity of rows that carry no id of their own.  A quote inside
an unquoted cell is literal, a doubled one in a quoted cell is one quote, lines
of blanks between records are skipped, and an empty cell is null.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.operators.fold import block_states
from quire.session import materialize, ship_package

KEEP = 1 << 20               # characters of a straddling record kept in the summary
BROADCAST_SPLITS = 1 << 17   # splits of one scan of rows; more are read as several scans
OUTSIDE, INSIDE = 0, 1       # how a line is entered
SPLIT = ["source", "file", "block"]   # what names a split

_QUOTED = r'(?:[^"]++|"")*+"[^,]*+'
_CELL = rf'(?:"{_QUOTED}|[^,"][^,]*+|)'
_CLOSED = [re.compile(rf"{_CELL}(?:,{_CELL})*+", re.S), re.compile(rf"{_QUOTED}(?:,{_CELL})*+", re.S)]
_NEXT_CELL = re.compile(r'(?:"((?:[^"]++|"")*+)"([^,]*+)|([^,]*+))(,|\Z)', re.S)


def canonical_number(c: str):
    """The value of a decimal string in its shortest form, else null: ``7`` but
    not ``007``, so no two different strings share a value."""
    n = F.expr(f"try_cast({c} AS BIGINT)")
    return F.when(n.cast("string") == F.col(c), n)


def after_line(line: str, state: int) -> int:
    """How the next line is entered."""
    if '"' not in line:
        return state
    return OUTSIDE if _CLOSED[state].fullmatch(line) else INSIDE


def cells_of(record: str) -> list[str | None]:
    """A record's cells; an empty one is null."""
    out, i = [], 0
    while True:
        m = _NEXT_CELL.match(record, i)
        quoted, rest, bare, separator = m.groups()
        out.append((quoted.replace('""', '"') + rest if quoted is not None else bare) or None)
        if not separator:
            return out
        i = m.end()


def _lines(spark: SparkSession, paths: dict) -> DataFrame:
    """The lines of files with their source, file and where their split begins."""
    def of(source: str) -> DataFrame:
        raw = spark.read.option("lineSep", "\n").text(paths[source])
        return raw.select(F.col("value").cast("binary").alias("line"), F.lit(source).alias("source"),
                          F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return reduce(DataFrame.unionByName, map(of, paths))


def _text(line: pa.Scalar) -> str:
    return line.as_py().decode("utf-8", "replace")


def _record(lines: list[str]) -> str:
    text = "\n".join(lines)
    return text[:-1] if text.endswith("\r") else text


class _Case:
    """A split read as entered outside or inside a quoted cell."""

    def __init__(self, state: int, keep: int):
        self.state, self.records, self.size, self.keep = state, 0, 0, keep
        self.open: list[str] | None = [] if state == INSIDE else None   # lines of the record that is open
        self.kept_head: str | None = None
        self.in_head = state == INSIDE

    def line(self, line: str, blank: bool):
        if self.state == OUTSIDE:
            if blank:
                return None
            self.records, self.open, self.size = self.records + 1, [], 0
        self.size += len(line) + 1
        if self.open is not None and self.size <= self.keep:
            self.open.append(line)
        else:
            self.open = None  # too long to keep
        self.state = after_line(line, self.state)
        if self.state == OUTSIDE:
            done, self.open = self.open, None
            if self.in_head:
                self.in_head, self.kept_head = False, None if done is None else "\n".join(done)
            return done
        return None

    def merged_with(self, other: _Case) -> bool:
        return self.state == OUTSIDE == other.state

    def row(self, other: _Case | None) -> dict:
        at = other or self
        text = None if at.open is None else "\n".join(at.open)
        inside = at.state == INSIDE
        return {"exit": at.state, "records": self.records, "head": text if self.in_head and inside else self.kept_head,
                "closes": not self.in_head, "tail": text if inside and not (self.in_head and other is None) else None}


def _summary(spark: SparkSession, lines: DataFrame, keep: int) -> DataFrame:
    """One row per split: file, block, header (of a file's first split) and, for
    either way of entering it, exit, records, head, closes, tail."""
    ship_package(spark)
    case = pa.struct([("exit", pa.int64()), ("records", pa.int64()), ("head", pa.string()), ("closes", pa.bool_()), ("tail", pa.string())])
    schema = pa.schema([("source", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("header", pa.list_(pa.string())),
                        ("outside", case), ("inside", case)])

    def scan(batches):
        at, out, header = None, [], None
        cases: list[_Case] = []
        extra = 0      # records of the merged case since it merged
        merged = False

        def flush():
            rows = [c.row(cases[0] if merged and c is not cases[0] else None) for c in cases]
            if merged:
                rows[1]["records"] += extra
            out.append({"source": at[0], "file": at[1], "block": at[2], "header": header, "outside": rows[0], "inside": rows[1]})

        for b in batches:
            for value, split in zip(b.column("line"), zip(*(b.column(c).to_pylist() for c in SPLIT)), strict=True):
                if at != split:
                    if at is not None:
                        flush()
                    at, header, merged, extra = split, None, False, 0
                    cases = [_Case(OUTSIDE, keep), _Case(INSIDE, keep)]
                line = _text(value)
                blank = not line.strip(" \t\r")
                before = cases[0].records
                done = cases[0].line(line, blank)
                if done is not None and header is None and at[2] == 0:
                    header = cells_of(_record(done).removeprefix("\ufeff"))
                if merged:
                    extra += cases[0].records - before
                else:
                    cases[1].line(line, blank)
                    merged = cases[0].merged_with(cases[1])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if at is not None:
            flush()
            yield pa.RecordBatch.from_pylist(out, schema)

    fields = "exit: long, records: long, head: string, closes: boolean, tail: string"
    return lines.mapInArrow(scan, f"source string, file string, block long, header array<string>, outside struct<{fields}>, inside struct<{fields}>")


def compose_splits(a: list[int], b: list[int]) -> list[int]:
    """The map of split a, then b.  A map is: first of its file; exit and number
    (of records, or levels) added when entered outside; the same for inside."""
    if b[0]:
        return b
    steps = [(b[1 + 2 * a[1 + 2 * s]], a[2 + 2 * s] + b[2 + 2 * a[1 + 2 * s]]) for s in (OUTSIDE, INSIDE)]
    return [a[0], *steps[0], *(steps[0] if a[0] else steps[1])]


def enter_split(m: list[int], state: list[int]) -> list[int]:
    """(how the next split is entered, number so far in the file)."""
    s, n = (OUTSIDE, 0) if m[0] else state
    return [m[1 + 2 * s], n + m[2 + 2 * s]]


def splits_of(spark: SparkSession, paths: dict, wanted: list[str], required: tuple[str, ...], keep: int = KEEP) -> DataFrame:
    """Per split: source, file, block, entry, base (records begun before it in its file,
    the header included), case (its summary as entered), picks (the places of
    the wanted columns, null where the file lacks one), error (why the file is
    refused, or null)."""
    s = materialize(_summary(spark, _lines(spark, paths), keep), "csv-splits")
    order = Window.orderBy(*SPLIT)  # one narrow row per split
    near = s.select(*SPLIT, "outside.exit", "outside.records", F.col("inside.exit").alias("exit1"), F.col("inside.records").alias("records1"))
    near = near.withColumn("n", F.row_number().over(order).cast("long") - 1)
    near = near.withColumn("first", ~F.lag(F.struct("source", "file")).over(order).eqNullSafe(F.struct("source", "file")))
    maps = near.select(F.col("n").alias("block"), F.array(F.col("first").cast("long"), "exit", "records", "exit1", "records1").alias("map"))
    states = block_states(maps, s.count(), [OUTSIDE, 0], compose_splits, enter_split)
    entered = near.join(states.select(F.col("block").alias("n"), "state"), "n").select(
        *SPLIT, F.when(F.col("first"), OUTSIDE).otherwise(F.col("state")[0]).cast("int").alias("entry"),
        F.when(F.col("first"), 0).otherwise(F.col("state")[1]).alias("base"))
    place = lambda c: F.nullif(F.array_position("header", c), F.lit(0)).cast("int") - 1
    headers = s.where(F.col("header").isNotNull()).select("source", "file", "header", F.array(*map(place, wanted)).alias("picks"))
    s = s.drop("header").join(entered, SPLIT).join(headers, ["source", "file"], "left")
    case = F.when(F.col("entry") == INSIDE, F.col("inside")).otherwise(F.col("outside"))
    lacks = F.filter(F.array(*[F.lit(c) for c in required]), lambda c: ~F.array_contains("header", c))
    error = F.when(F.col("header").isNull(), F.concat("file", F.lit(" has no header"))).when(F.size(lacks) > 0, F.format_string(
        "%s has no column '%s': [%s]", "file", lacks[0], F.array_join("header", ", ", "")))
    return materialize(s.select(*SPLIT, "entry", "base", case.alias("case"), "picks", error.alias("error")), "csv-entered")


def _row_schema(wanted: list[str]) -> pa.Schema:
    return pa.schema([("source", pa.string()), ("file", pa.string()), ("row", pa.int64()),
                      *[(f"c{i}", pa.string()) for i in range(len(wanted))]])


def _cut(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """Complete records of lines that know how their split is entered."""
    schema = _row_schema(wanted)

    def rows(batches):
        at, held, state, n, picks = None, None, OUTSIDE, 0, []
        for b in batches:
            out: list[list] = [[] for _ in schema.names]
            for i, (value, split) in enumerate(zip(b.column("line"), zip(*(b.column(c).to_pylist() for c in SPLIT)), strict=True)):
                if at != split:
                    at, state, n = split, b.column("entry")[i].as_py(), b.column("base")[i].as_py()
                    picks = b.column("picks")[i].as_py()
                    held = None  # lines of a record that began before the split
                line = _text(value)
                if state == OUTSIDE:
                    if not line.strip(" \t\r"):
                        continue
                    held, n = [], n + 1
                if held is not None:
                    held.append(line)
                state = after_line(line, state)
                if state == OUTSIDE and held is not None and n > 1:
                    cells = cells_of(_record(held))
                    out[0].append(at[0])
                    out[1].append(at[1])
                    out[2].append(n - 2)
                    for k, p in enumerate(picks):
                        out[k + 3].append(cells[p] if p is not None and p < len(cells) else None)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return lines.mapInArrow(rows, "source string, file string, row long, " + ", ".join(f"c{i} string" for i in range(len(wanted))))


def _has_head():
    return F.col("entry") == INSIDE


def _has_tail():
    return (F.col("case.exit") == INSIDE) & F.col("case.closes")


def _not_kept():
    """A straddling record of this split was too long for the summary."""
    return (_has_head() & F.col("case.head").isNull()) | (_has_tail() & F.col("case.tail").isNull())


def _fragments(lines: DataFrame, splits: DataFrame, all_kept: bool) -> DataFrame:
    """(source, file, row, block, part): the pieces of records that straddle splits."""
    head = splits.where(_has_head()).select("source", "file", (F.col("base") - 2).alias("row"), "block", F.col("case.head").alias("part"),
                                            F.lit(True).alias("is_head"))
    tail = splits.where(_has_tail()).select("source", "file", (F.col("base") + F.col("case.records") - 2).alias("row"), "block",
                                            F.col("case.tail").alias("part"), F.lit(False).alias("is_head"))
    kept = head.unionByName(tail)
    if all_kept:
        return kept.drop("is_head")
    long_ones = kept.where(F.col("part").isNull())
    ends = long_ones.groupBy(*SPLIT).agg(F.max(F.when(F.col("is_head"), F.col("row"))).alias("head"),
                                         F.max(F.when(~F.col("is_head"), F.col("row"))).alias("tail"))
    again = lines.join(F.broadcast(ends.join(splits.select(*SPLIT, "entry"), SPLIT)), SPLIT)

    def gather(batches):
        at, pieces, out = None, None, []

        def flush():
            for row, part in pieces:
                if row is not None and part:
                    out.append({"source": at[0], "file": at[1], "row": row, "block": at[2], "part": "\n".join(part)})

        state = OUTSIDE
        for b in batches:
            for r in b.to_pylist():
                if at != (split := tuple(r[c] for c in SPLIT)):
                    if at is not None:
                        flush()
                    at, pieces = split, [(r["head"], []), (r["tail"], [])]
                    state, which = r["entry"], 0 if r["entry"] == INSIDE else 1
                line = r["line"].decode("utf-8", "replace")
                if state == OUTSIDE and line.strip(" \t\r"):
                    which = 1
                    pieces[1][1].clear()
                pieces[which][1].append(line)
                state = after_line(line, state)
        if at is not None:
            flush()
        yield pa.RecordBatch.from_pylist(out, pa.schema([("source", pa.string()), ("file", pa.string()), ("row", pa.int64()),
                                                         ("block", pa.int64()), ("part", pa.string())]))

    read = again.mapInArrow(gather, "source string, file string, row long, block long, part string")
    return kept.where(F.col("part").isNotNull()).drop("is_head").unionByName(read)


def rows_by_header(spark: SparkSession, paths: dict, wanted: list[str], required: tuple[str, ...] = ("text",),
                   refused: str | None = None, keep: int = KEEP) -> DataFrame:
    """``source``, ``file``, ``row`` (from 0, header excluded) and the ``wanted``
    columns of the files of all sources (name -> path), in one scan; null where a
    file lacks one.  A file without a header or a ``required`` column is an
    error; with ``refused`` (a path) it has no rows, and (file, error) of all such
    files is written there."""
    splits = splits_of(spark, paths, wanted, required, keep)
    n, error, all_kept = splits.agg(F.count(F.lit(1)), F.min("error"), F.bool_and(~_not_kept())).first()
    if error is not None and refused is None:
        raise ValueError(error)
    if error is not None:
        splits.where("error IS NOT NULL").groupBy("file").agg(F.min("error").alias("error")).write.mode("overwrite").parquet(refused)
        splits = splits.where("error IS NULL")
    lines = _lines(spark, paths)
    scans = n // BROADCAST_SPLITS + 1
    known = splits.select(*SPLIT, "entry", "base", "picks")

    def scan(i: int) -> DataFrame:
        mine = known.where(F.pmod(F.xxhash64("file"), F.lit(scans)) == i) if scans > 1 else known
        return _cut(lines.join(F.broadcast(mine), SPLIT), wanted)

    whole = reduce(DataFrame.unionByName, [scan(i) for i in range(scans)])
    row = ["source", "file", "row"]
    parts = _fragments(lines, splits, all_kept is not False)
    straddling = parts.groupBy(*row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("block", "part"))), lambda p: p["part"]), "\n").alias("record")).where("row >= 0")
    straddling = straddling.join(splits.select("source", "file", "picks").distinct(), ["source", "file"])
    schema = _row_schema(wanted)

    def cut_whole(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                cells = cells_of(_record([r["record"]]))
                out.append({c: r[c] for c in row} | {f"c{k}": cells[p] if p is not None and p < len(cells) else None
                                                     for k, p in enumerate(r["picks"])})
            yield pa.RecordBatch.from_pylist(out, schema)

    joined = straddling.mapInArrow(cut_whole, whole.schema)
    return whole.unionByName(joined).select(*row, *[F.col(f"c{i}").alias(c) for i, c in enumerate(wanted)])
