"""Clinical notes as (gzipped) CSV.

Every file is bound to its own header (``csv_rows``); columns are strings.
Metadata columns are dropped when present (P1); ``text`` becomes
``clinical_text`` after NA-token nulling and whitespace cleaning (P2, T1).
Rows keep their ``file`` and ``row`` (lineage and input order).  Uncompressed
files are read in splits although quoted cells hold newlines; a gzip file is one
task by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import clean_text, na_to_null
from quire.sources.csv_rows import canonical_number, rows_by_header

NOTE_COLUMNS = ["note_id", "text"]


def note_key(c: str):
    """Ids in canonical decimal form keep their value; others (e.g.
    '10000032-DS-21', '007') hash to a stable 64-bit key; a row without an id
    is named by its file and row."""
    return F.coalesce(canonical_number(c), F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c))),
                      F.xxhash64("file", "row"))


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    """Drop the named columns that exist; ignore the others."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present)


def drop_prefixed(df: DataFrame, prefix: str = "__") -> DataFrame:
    """Drop every column whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def note_text(clean: bool = True):
    text = na_to_null(F.col("text"))
    return clean_text(text) if clean else text


def read_notes(spark: SparkSession, path, label: str, clean: bool = True, refused: str | None = None) -> DataFrame:
    """Notes of files; ``refused`` (a path) sets bad files aside there."""
    rows = rows_by_header(spark, {label: path}, NOTE_COLUMNS, refused=refused)
    return rows.select(note_key("note_id").alias("doc_id"), "source", note_text(clean).alias("clinical_text"), "file", "row")
