"""S3: code-table CSVs (diagnosis, procedure, HCPCS).

Only the rendered ``text`` column is used; it is copied unchanged (no
whitespace cleaning, as for the reference's code tables) after NA nulling.
A code is identified by its version and code string (``code_key``): ``010``,
``10`` and another version's ``10`` are three codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import na_to_null
from quire.sources.csv_rows import canonical_number, rows_by_header

CODE_COLUMNS = ["version", "code", "text"]


def code_id():
    """A canonical decimal code's value, otherwise a hash of (source, version,
    code), or of (file, row) without a code."""
    other = F.when(F.col("code").isNotNull(), F.xxhash64("source", "version", "code"))
    return F.coalesce(canonical_number("code"), other, F.xxhash64("file", "row"))


def read_code_table(spark: SparkSession, path, label: str) -> DataFrame:
    """doc_id, clinical_text, source, code_key (the exact key), file, row."""
    rows = rows_by_header(spark, {label: path}, CODE_COLUMNS)
    return rows.select(code_id().alias("doc_id"), na_to_null(F.col("text")).alias("clinical_text"), "source",
                       F.concat_ws(":", F.coalesce("version", F.lit("")), "code").alias("code_key"), "file", "row")
