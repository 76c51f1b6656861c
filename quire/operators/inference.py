"""Batch embedding (E1, E2), first-token pooling (E3), encoder input
projection (P12).

An encoder is a small spec: ``make_predict_fn`` builds the model once per
Python worker and returns ``predict(batch) -> ndarray[batch, dim]`` of
first-token states (pool inside the function so only one vector per row
crosses Arrow); ``inputs`` lists the columns the model accepts (others,
such as ``token_type_ids`` for distilled encoders, are dropped).  Spark's
``predict_batch_udf`` feeds fixed-size batches (default 64, as the
reference's benchmark) from Arrow record batches.

No model weights ship with this repository.  ``HashedBagEncoder`` is a
deterministic stand-in (signed hashed bag of tokens, L2-normalised), so the
pipeline runs end to end and results are reproducible; swap in a real model
with the same spec.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from quire.session import ship_package


def first_token_pool(hidden: np.ndarray) -> np.ndarray:
    """[batch, seq, dim] -> [batch, dim] (the first token's state)."""
    return hidden[:, 0, :]


def first_token_column(flat, dim: int):
    """E3 on a flattened [seq * dim] array column: its first ``dim`` values."""
    c = F.col(flat) if isinstance(flat, str) else flat
    return F.slice(c, 1, dim)


def hashed_bags(rows: list[list[str]], dim: int) -> np.ndarray:
    """Unit signed hashed bags of a batch of token lists.  A token's first eight
    MD5 digits h give its place, ``h % dim``, and sign (+ if ``h // dim`` is odd);
    each distinct token of the batch is hashed once."""
    out = np.zeros((len(rows), dim))
    flat = [t for r in rows for t in r]
    if flat:
        kinds, at = np.unique(np.array(flat, dtype=object), return_inverse=True)
        h = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in kinds], dtype=np.int64)[at]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        np.add.at(out, (owner, h % dim), np.where(h // dim % 2 == 1, 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class HashedBagEncoder:
    """Stand-in encoder: text -> whitespace tokens (truncated like a
    ``max_length`` tokenizer with two specials) -> signed hashed bag."""
    dim: int = 64
    max_length: int = 512
    inputs: tuple = ("text",)
    name: str = "hashed-bag"

    def make_predict_fn(self):
        dim, keep = self.dim, max(0, self.max_length - 2)

        def predict(texts: np.ndarray) -> np.ndarray:
            return hashed_bags([("" if t is None else str(t)).split()[:keep] for t in texts], dim)
        return predict


@dataclass
class HashedIdsEncoder:
    """Stand-in encoder over token ids (E2): ids where the mask is 1,
    specials (< n_specials) ignored."""
    dim: int = 64
    n_specials: int = 5
    inputs: tuple = ("input_ids", "attention_mask")
    name: str = "hashed-ids"
    extra: dict = field(default_factory=dict)

    def make_predict_fn(self):
        dim, ns = self.dim, self.n_specials

        def predict(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            live = (np.asarray(mask) != 0) & (np.asarray(ids) >= ns)
            return hashed_bags([[str(int(i)) for i in row[ok]] for row, ok in zip(np.asarray(ids), live)], dim)
        return predict


def project_inputs(df: DataFrame, encoder, keep=()) -> DataFrame:
    """Drop model-input columns the encoder does not accept."""
    model_cols = {"input_ids", "attention_mask", "token_type_ids"}
    drop = [c for c in df.columns if c in model_cols and c not in encoder.inputs and c not in keep]
    return df.drop(*drop)


def embed(df: DataFrame, encoder=None, batch_size: int = 64, max_length: int = 512,
          text_col: str = "clinical_text", id_col: str = "doc_id") -> DataFrame:
    """(id, embedding array<float>) from text; the built-in encoder
    truncates at ``max_length`` tokens like the reference's tokenizer call.  A row
    without text keeps its place with a null embedding."""
    ship_package(df.sparkSession)
    from pyspark.ml.functions import predict_batch_udf
    encoder = encoder or HashedBagEncoder(max_length=max_length)
    udf = predict_batch_udf(encoder.make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size)
    text = F.col(text_col)
    return df.select(id_col, F.when(text.isNotNull(), udf(F.coalesce(text, F.lit("")))).alias("embedding"))


def embed_tokens(df: DataFrame, encoder=None, batch_size: int = 64, max_length: int = 512,
                 id_col: str = "doc_id") -> DataFrame:
    """(id, embedding) from pre-tokenised fixed-width rows."""
    ship_package(df.sparkSession)
    from pyspark.ml.functions import predict_batch_udf
    encoder = encoder or HashedIdsEncoder()
    df = project_inputs(df, encoder)
    cols = [c for c in encoder.inputs]
    udf = predict_batch_udf(encoder.make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size,
                            input_tensor_shapes=[[max_length] for _ in cols])
    casted = [F.col(c).cast("array<int>") for c in cols]
    return df.select(id_col, udf(*casted).alias("embedding"))
