"""Patient records.

``layout="object"``: files that are one JSON object ``{patient_id: {field:
text}}``, read in splits (``json_objects``), one row per patient.
``layout="lines"``: JSON lines with a ``patient_id`` field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quire.schemas import PATIENT_FIELDS, PATIENT_LINES_SCHEMA, PATIENT_STRUCT
from quire.sources.json_objects import object_entries


def read_patients(spark: SparkSession, path, layout: str = "lines") -> DataFrame:
    if layout == "lines":
        return spark.read.schema(PATIENT_LINES_SCHEMA).json(path)
    if layout == "object":
        entries = object_entries(spark, path)
        parsed = F.from_json("json", T.MapType(T.StringType(), PATIENT_STRUCT))
        bad = F.raise_error(F.concat(F.lit("malformed patient entry in "), "file"))
        rows = entries.select(F.explode(F.when(parsed.isNotNull(), parsed).otherwise(bad.cast(
            T.MapType(T.StringType(), PATIENT_STRUCT)))).alias("patient_id", "r"))
        return rows.select("patient_id", *[F.col(f"r.{c}").alias(c) for c in PATIENT_FIELDS])
    raise ValueError(f"unknown layout {layout!r}")
