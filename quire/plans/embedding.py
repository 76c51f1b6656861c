"""Patient records -> embeddings (the reference's embedding benchmark, data
side): JSON -> documents (E4) -> optional prefix (W2) -> batched embedding
(E1) -> Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.operators.inference import embed
from quire.operators.ordering import take_prefix, with_positions
from quire.operators.patients import patient_documents
from quire.sources.patients import read_patients


def embed_patients(spark: SparkSession, json_path: str, out_path: str, layout: str = "lines",
                   limit_rows: int | None = None, encoder=None, batch_size: int = 64,
                   max_length: int = 512) -> str:
    # a patient without a complete document stays, with a null embedding
    docs = patient_documents(read_patients(spark, json_path, layout))
    if limit_rows is not None:
        docs = take_prefix(with_positions(docs, ["patient_id"]), limit_rows)
    embed(docs, encoder, batch_size, max_length, text_col="info", id_col="patient_id") \
        .write.mode("overwrite").parquet(out_path)
    return out_path
