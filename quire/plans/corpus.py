"""Corpus build (U1 + W1): six sources in fixed order -> one typed corpus.

The total order is input order: ``(source_rank, file, block, row)``.  CSV rows
know their number in their file (``block`` is 0); articles are numbered as they
leave the task that read their split (``block`` is where it begins).  ``pos``
numbers the rows 0..n-1 in that order from counts per file or split: each source
is parsed once and no text is shuffled.
``doc_id`` is assigned at ingest (note id, PMID, code) and need not be unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from quire.functions.text import na_to_null
from quire.operators.ordering import number_in_input_order
from quire.schemas import SOURCE_ORDER
from quire.sources.articles import read_articles
from quire.sources.codes import CODE_COLUMNS, code_id, read_code_table
from quire.sources.csv_rows import rows_by_header
from quire.sources.notes import NOTE_COLUMNS, note_key, note_text, read_notes

NOTE_SOURCES = ("discharge", "radiology")
CODE_SOURCES = ("diagnosis", "procedure", "hcpcs")


def read_source(spark: SparkSession, source: str, path) -> DataFrame:
    if source in NOTE_SOURCES:
        df = read_notes(spark, path, source)
    elif source == "articles":
        df = read_articles(spark, path)
    elif source in CODE_SOURCES:
        df = read_code_table(spark, path, source)
    else:
        raise ValueError(f"unknown source {source!r}")
    extra = ["code_key"] if "code_key" in df.columns else []
    if "block" in df.columns:  # numbered after its filters, in the task that read the split
        place = [F.col("block"), F.monotonically_increasing_id().alias("row")]
    else:
        place = [F.lit(0).cast("long").alias("block"), F.col("row")]
    return df.select("doc_id", "source", "clinical_text", "file", *place, *extra)


def csv_corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Notes and code tables, all files in one scan."""
    rows = rows_by_header(spark, paths, sorted({*NOTE_COLUMNS, *CODE_COLUMNS}))
    note = F.col("source").isin(*NOTE_SOURCES)
    return rows.select(F.when(note, note_key("note_id")).otherwise(code_id()).alias("doc_id"), "source",
                       F.when(note, note_text()).otherwise(na_to_null(F.col("text"))).alias("clinical_text"),
                       "file", F.lit(0).cast("long").alias("block"), "row")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union-all by name with ``source_rank`` carrying the fixed order."""
    if not frames:
        raise ValueError("no sources given")
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source")).cast("int") - 1
    return reduce(DataFrame.unionByName, frames).withColumn("source_rank", rank)


def build_corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    unknown = set(paths) - set(SOURCE_ORDER)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}")
    tables = {s: p for s, p in paths.items() if s in NOTE_SOURCES + CODE_SOURCES}
    frames = [csv_corpus(spark, tables)] if tables else []
    frames += [read_source(spark, "articles", paths["articles"])] if "articles" in paths else []
    corpus = number_in_input_order(union_sources(frames), ["source_rank", "file", "block"], "row")
    return corpus.select("doc_id", "source", "source_rank", "pos", "clinical_text")
