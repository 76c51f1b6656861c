"""Article records parsed by events, one Arrow batch at a time.

A record is a stream of expat events; a small state machine keeps the open
element path and at most one *capture*, the text at the start of an element of
interest.  A capture ends at the element's first child of any kind (element,
comment or processing instruction) or at its end, so ``T <i>x</i> tail`` gives
``T`` and text around a CDATA section is kept whole.  Names in a namespace do
not match.  No tree is built, so a long record costs no more than its text.  A
batch is taken a few MB at a time: its records, as Python strings, their fields
and the fields as columns would together be many times the batch.

A malformed record yields its error message instead of fields; the caller
decides whether that fails the job or is set aside.
"""

from __future__ import annotations

from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.session import ship_package

SCHEMA = ("pmid string, title string, abstract string, error string, xml string, "
          "file string, block long, row long")
# Elements whose first occurrence counts, and their columns.
FIRST = {"PMID": "pmid", "ArticleTitle": "title"}
# ... and the element of which every occurrence counts, under its parent.
EVERY, PARENT = "AbstractText", "Abstract"
SLICE_BYTES = 4 << 20   # of records that are Python objects at a time


class _Events:
    """The fields of one record, filled in while its events pass by."""

    def __init__(self):
        self.path: list[str] = []
        self.fields: dict[str, str | None] = {"pmid": None, "title": None}
        self.seen: set[str] = set()
        self.parts: list[str] = []
        self.target: str | None = None    # column or EVERY while a capture is open
        self.text: list[str] = []

    def start(self, name, _attributes):
        self.close()
        parent = self.path[-1] if self.path else None
        self.path.append(name)
        if name == EVERY and parent == PARENT:
            self.target = EVERY
        elif name in FIRST and name not in self.seen:
            self.seen.add(name)
            self.target = FIRST[name]

    def end(self, _name):
        self.close()
        self.path.pop()

    def chars(self, data):
        if self.target:
            self.text.append(data)

    def close(self, *_):
        if self.target and self.text:
            leading = "".join(self.text)
            if self.target == EVERY:
                self.parts.append(leading.strip())
            else:
                self.fields[self.target] = leading.strip()
        self.target, self.text = None, []


def fields_of(record: str) -> tuple[str | None, str | None, str | None, str | None]:
    """(pmid, title, abstract, error) of one record."""
    events = _Events()
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = events.start, events.end
    parser.CharacterDataHandler = events.chars
    parser.CommentHandler = parser.ProcessingInstructionHandler = events.close
    try:
        parser.Parse(record, True)
    except expat.ExpatError as e:
        return None, None, None, str(e)
    return events.fields["pmid"], events.fields["title"], " ".join(events.parts), None


def _slices(batches, limit: int = SLICE_BYTES):
    """The batches in runs of records of ``limit`` bytes or less each; one longer
    record is a run of its own."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("xml")).to_numpy(zero_copy_only=False), dtype=np.int64)
        i, n = 0, len(ends)
        while i < n:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right"))
            j = max(i + 1, j)
            yield b.slice(i, j - i)
            i = j


def _parse(batches):
    place, row = None, 0
    for b in _slices(batches):
        xml, file, block = (b.column(c).to_pylist() for c in ("xml", "file", "block"))
        columns = list(zip(*map(fields_of, xml), strict=True)) or [[]] * 4
        kept = [x if e is not None else None for x, e in zip(xml, columns[3], strict=True)]
        rows = []
        for here in zip(file, block, strict=True):  # records number from 0 in each split
            row = row + 1 if here == place else 0
            place = here
            rows.append(row)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.string()) for c in columns), pa.array(kept, pa.string()), b.column("file"),
             b.column("block"), pa.array(rows, pa.int64())],
            ["pmid", "title", "abstract", "error", "xml", "file", "block", "row"])


def parse_records(records: DataFrame) -> DataFrame:
    """``records``: xml, file, block.  Adds pmid, title, abstract, error and
    row (the record's number in its split); xml stays on malformed ones."""
    ship_package(records.sparkSession)
    return records.select("xml", "file", "block").mapInArrow(_parse, SCHEMA)
