"""Patient records -> one document per patient plus a binary label.

P7 label, P6 default sentences, P8 drops, P9 ``info`` assembly (plain
``concat``: no separator, null if any part is null), P10 label last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.sources.notes import drop_if_present

# Default sentences for missing fields.
FILL_DEFAULTS = {
    "medrecon": "The patient was previously not taking any medications.",
    "pyxis": "The patient did not receive any medications.",
    "vitals": "The patient had no vitals recorded",
    "codes": "The patient received no diagnostic codes",
}
INFO_PARTS = ["arrival", "codes", "triage", "vitals", "pyxis", "medrecon"]
DROPPED = ["admission", "discharge", "eddischarge_category"]
LABEL = "eddischarge"


def admitted_label(c) -> F.Column:
    """1 if the lower-cased disposition contains 'admitted' (null -> 0)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.lower(col).contains("admitted"), F.lit(1)).otherwise(F.lit(0))


def fill_defaults(df: DataFrame) -> DataFrame:
    """P6."""
    return df.fillna({k: v for k, v in FILL_DEFAULTS.items() if k in df.columns})


def assemble_info(df: DataFrame) -> DataFrame:
    """P9 then P8 on the parts."""
    return df.withColumn("info", F.concat(*[F.col(c) for c in INFO_PARTS])).drop(*INFO_PARTS)


def label_last(df: DataFrame, label: str = LABEL) -> DataFrame:
    """P10."""
    return df.select(*[c for c in df.columns if c != label], label)


def patient_documents(patients: DataFrame) -> DataFrame:
    df = patients.withColumn(LABEL, admitted_label(LABEL))
    df = fill_defaults(df)
    df = drop_if_present(df, DROPPED)
    df = assemble_info(df)
    return label_last(df)
