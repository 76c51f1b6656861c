"""Corpus and tokenised-dataset sinks (Parquet).

The corpus is written partitioned by ``source`` so a reader's source
predicate prunes whole directories and other predicates push into the
Parquet scan.  A table of numbered rows can be laid out by position instead:
a folder per run of ``chunk_rows`` positions, so that a prefix (W2) or a range of
batches (W3) reads the folders it touches and no others.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quire.operators.ordering import assign_batches
from quire.operators.profile import ObservedProfile
from quire.schemas import SOURCE_ORDER

CHUNK = "pos_chunk"


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).partitionBy("source").parquet(path)
    return path


def write_corpus_profiled(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write the corpus and return its profile (A1-A3), measured in the write."""
    watch = ObservedProfile(SOURCE_ORDER)
    write_corpus(watch.watch(df), path, mode)
    return watch.result(df.sparkSession)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tokenized(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Materialise a tokenised dataset; index-like ``__`` columns dropped."""
    from quire.sources.notes import drop_prefixed
    drop_prefixed(df).write.mode(mode).parquet(path)
    return path


def write_positions(df: DataFrame, path: str, chunk_rows: int = 1 << 20, pos_col: str = "pos",
                    in_order: bool = True) -> str:
    """Lay numbered rows out by position.  Rows that the ordering operators have
    just numbered lie in runs of positions, so each task writes few folders and
    nothing is shuffled; with ``in_order=False`` they are ranged first.  Rows
    without a position are kept, but no range has them."""
    if CHUNK in df.columns:
        raise ValueError(f"column name {CHUNK!r} is taken by the layout")
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    df = df if in_order else df.repartitionByRange(pos_col)
    rows = df.withColumn(CHUNK, F.expr(f"`{pos_col}` div {chunk_rows}").cast("long"))
    rows.write.mode("overwrite").partitionBy(CHUNK).parquet(f"{path}/rows")
    layout = [(chunk_rows, pos_col, rows.schema.json())]
    (df.sparkSession.createDataFrame(layout, "chunk_rows long, pos_col string, schema string").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/layout"))
    return path


def read_positions(spark: SparkSession, path: str, first: int = 0, stop: int | None = None) -> DataFrame:
    """Rows with ``first`` <= position < ``stop`` (None: to the end)."""
    chunk_rows, pos_col, schema = spark.read.parquet(f"{path}/layout").first()
    rows = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/rows")
    pos, chunk = F.col(pos_col), F.col(CHUNK)
    rows = rows.where((pos >= first) & (chunk >= first // chunk_rows))
    if stop is not None:
        rows = rows.where((pos < stop) & (chunk <= (stop - 1) // chunk_rows))
    return rows.drop(CHUNK)


def read_batches(spark: SparkSession, path: str, first: int, stop: int, batch_size: int = 64) -> DataFrame:
    """Rows of the batches ``first`` to ``stop`` - 1 with their ``batch_id``."""
    pos_col = spark.read.parquet(f"{path}/layout").first()["pos_col"]
    return assign_batches(read_positions(spark, path, first * batch_size, stop * batch_size), batch_size, pos_col)
