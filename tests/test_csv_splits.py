"""CSV files read in splits: against Python's own reader, at any split size."""

import csv
import gzip
import io
import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from quire.sources import csv_rows as C
from quire.sources.notes import read_notes
from quire.streaming.ingest import ingest_notes_stream, note_stream_errors

WANTED = ["note_id", "text"]
BITS = ["a", "bc", '"', ",", "\n", "é", " ", "long " * 30, 'say ""', "\r", "x\ny"]


def content(rng, n, columns=("subject_id", "note_id", "text")):
    """A file of n records, and its rows."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]))
    w.writerow(columns)
    rows = []
    for i in range(n):
        text = "".join(rng.choice(BITS[:9] + BITS[10:]) for _ in range(rng.choice([0, 1, 3, 8])))
        rows.append((str(i), text or None))
        w.writerow([{"note_id": str(i), "text": text}.get(c, "S,1") for c in columns])
        if rng.random() < 0.1:
            out.write(rng.choice(["\n", "  \n"]))
    return out.getvalue(), rows


@pytest.fixture
def split_size(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]

    def put(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield put
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_one_file_in_many_tasks_equals_python(spark, tmpdir_path, split_size):
    rng = random.Random(11)
    body, rows = content(rng, 600)
    other, more = content(rng, 40, columns=("text", "note_id"))
    giant = 'note_id,text\n1,"' + "line\n" * 3000 + '"\n2,"b""\n"\n3,no quote ""\n'
    files = {"a.csv": body, "b.csv": other, "c.csv": giant, "d.csv": "﻿note_id,text\n1,x\n2", "e.csv": ""}
    for name, text in files.items():
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    with gzip.open(os.path.join(tmpdir_path, "f.csv.gz"), "wt", encoding="utf-8", newline="") as f:
        f.write(body)
    expected = {"a.csv": rows, "b.csv": more, "c.csv": [("1", "line\n" * 3000), ("2", 'b"\n'), ("3", 'no quote ""')],
                "d.csv": [("1", "x"), ("2", None)], "f.csv.gz": rows}
    for size, keep in ((1 << 20, C.KEEP), (997, C.KEEP), (300, 40)):
        split_size(size)
        got = C.rows_by_header(spark, {"n": tmpdir_path}, WANTED, keep=keep)
        found = {}
        for r in got.collect():
            found.setdefault(os.path.basename(r.file), {})[r.row] = (r.note_id, r.text)
        for name, e in expected.items():
            assert [found[name].get(i) for i in range(len(e))] == e, (size, keep, name)
            assert len(found[name]) == len(e)
        assert set(found) == set(expected)
        if size == 997:
            lines = C._lines(spark, {"n": os.path.join(tmpdir_path, "a.csv")})
            assert lines.select("block").distinct().count() > 20
    rows_of_a = read_notes(spark, [os.path.join(tmpdir_path, "a.csv"), os.path.join(tmpdir_path, "f.csv.gz")], "n").count()
    assert rows_of_a == 1200


def test_two_sources_and_refused_files(spark, tmpdir_path):
    for d in ("x", "y"):
        os.makedirs(os.path.join(tmpdir_path, d))
    for name, text in (("x/a.csv", "note_id,text\n1,one\n"), ("y/a.csv", "text,code\ntwo,2\n"), ("y/b.csv", "note_id,body\n1,x\n"),
                       ("y/c.csv", '"note_id,text\nnever closed\n')):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    paths = {"x": os.path.join(tmpdir_path, "x"), "y": os.path.join(tmpdir_path, "y")}
    with pytest.raises(ValueError, match="no column 'text'|no header"):
        C.rows_by_header(spark, paths, WANTED)
    refused = os.path.join(tmpdir_path, "refused")
    rows = C.rows_by_header(spark, paths, ["note_id", "code", "text"], refused=refused).collect()
    assert sorted((r.source, r.row, r.note_id, r.code, r.text) for r in rows) == [("x", 0, "1", None, "one"), ("y", 0, None, "2", "two")]
    errors = {os.path.basename(r.file): r.error for r in spark.read.parquet(refused).collect()}
    assert set(errors) == {"b.csv", "c.csv"} and "no column 'text'" in errors["b.csv"] and "no header" in errors["c.csv"]


def test_stream_sets_bad_files_aside(spark, tmpdir_path):
    src, sink, ckpt = (os.path.join(tmpdir_path, d) for d in ("src", "sink", "ckpt"))
    os.makedirs(src)
    assert ingest_notes_stream(spark, src, sink, ckpt, "d").count() == 0
    wide = ",".join(f"c{i}" for i in range(60))
    for name, text in (("a [1].csv", "note_id,text\n1,one\n"), ("bad.csv", "note_id,body\n2,x\n"),
                       ("wide.csv", f"{wide},text\n{wide},w\n")):
        with open(os.path.join(src, name), "w") as f:
            f.write(text)
    got = ingest_notes_stream(spark, src, sink, ckpt, "d", max_files_per_trigger=1)
    assert sorted(r.clinical_text for r in got.collect()) == ["one", "w"]
    with open(os.path.join(src, "later.csv"), "w") as f:
        f.write("text\nthree\n")
    for _ in range(2):
        got = ingest_notes_stream(spark, src, sink, ckpt, "d")
    assert sorted(r.clinical_text for r in got.collect()) == ["one", "three", "w"]
    assert ["no column 'text'" in r.error for r in note_stream_errors(spark, sink).collect()] == [True]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", 'b"c', "d,e", "f\ng", '"', '""', " h "]), min_size=1, max_size=4), min_size=1, max_size=6))
def test_line_states_and_cells_equal_python(records):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records)
    state, lines, found = C.OUTSIDE, [], []
    for line in out.getvalue().split("\n")[:-1]:
        lines.append(line)
        state = C.after_line(line, state)
        if state == C.OUTSIDE:
            found.append(C.cells_of("\n".join(lines)))
            lines = []
    assert found == [[c or None for c in r] for r in records]


def test_map_composition_is_associative():
    rng = random.Random(2)
    maps = [[rng.random() < 0.2, rng.randrange(2), rng.randrange(9), rng.randrange(2), rng.randrange(9)] for _ in range(60)]
    maps = [[int(f), a, n, *((a, n) if f else (b, m))] for f, a, n, b, m in maps]
    for a, b, c in zip(maps, maps[1:], maps[2:]):
        assert C.compose_splits(C.compose_splits(a, b), c) == C.compose_splits(a, C.compose_splits(b, c))
        for s in ([0, 5], [1, 7]):
            assert C.enter_split(C.compose_splits(a, b), s) == C.enter_split(b, C.enter_split(a, s))
