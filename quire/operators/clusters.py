"""E5: label clustering report for embeddings.

Centroid per label (``posexplode`` + partial ``avg`` per (label, dim): the
pre-aggregation keeps shuffle size at labels x dims per task), made a unit
vector once, then every vector's cosine to its own centroid and to the nearest
other one.  The vectors are scanned once: each Arrow batch is multiplied with the
centroids, ``TILE`` rows at a time, and a row carries its two best cosines along,
so no row is joined or merged by an id.  Centroids reach the tasks in blocks of
at most ``BLOCK_BYTES``; with more labels than fill one block, the rows pass
through one step per block in the same scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import materialize, ship_package

BLOCK_BYTES = 64 << 20
TILE = 4096


def centroids(df: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    x = df.select(label_col, F.posexplode(vec_col).alias("__d", "__v"))
    per = x.groupBy(label_col, "__d").agg(F.avg(F.col("__v").cast("double")).alias("__c"))
    return per.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("__d", "__c"))).alias("__p")) \
        .select(label_col, F.transform("__p", lambda p: p["__c"]).alias("centroid"))


def unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of length one; NaN where a vector is null, of another
    length, zero, or holds a null."""
    out = np.full((len(vectors), dim), np.nan)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy()
    fits = np.flatnonzero(lengths == dim)
    if len(fits) and dim:
        flat = vectors.filter(pa.array(lengths == dim)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(-1, dim)
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[fits] = rows / np.where(norm == 0, np.nan, norm)
    return out


def _closer(shared):
    """Rows whose own and other cosines take a block of centroids into account."""
    def step(batches):
        labels, matrix = shared.value
        place = {label: i for i, label in enumerate(labels)}
        for b in batches:
            own, other = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("own", "other"))
            mine = np.array([place.get(x, -1) for x in b.column("label").to_pylist()], np.int64)
            for i in range(0, b.num_rows, TILE):
                j = min(b.num_rows, i + TILE)
                cosines = unit_rows(b.column("vec").slice(i, j - i), matrix.shape[1]) @ matrix.T
                here = np.flatnonzero(mine[i:j] >= 0)
                own[i + here] = cosines[here, mine[i + here]]
                cosines[here, mine[i + here]] = np.nan
                other[i:j] = np.fmax(other[i:j], np.fmax.reduce(cosines, axis=1))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("vec"), pa.array(own), pa.array(other)],
                                             ["label", "vec", "own", "other"])
    return step


def cluster_report(df: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per label: n_vectors, mean_own_cosine, mean_nearest_other_cosine.  Every
    row counts, whatever its id; a null, zero or odd-sized vector has no cosines;
    a null label is a label."""
    spark = df.sparkSession
    ship_package(spark)
    c = materialize(centroids(df.where(F.col(vec_col).isNotNull()), vec_col, label_col).select(
        F.col(label_col).alias("label"), "centroid"), "centroids")
    n, dim = c.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    blocks = n * dim * 8 // block_bytes + 1
    nothing = F.lit(float("nan"))
    v = df.select(F.col(label_col).alias("label"), F.col(vec_col).alias("vec"), nothing.alias("own"), nothing.alias("other"))
    for i in range(blocks if n else 0):
        mine = c.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == i).toArrow()   # at most about block_bytes
        if mine.num_rows:
            shared = spark.sparkContext.broadcast((mine["label"].to_pylist(), unit_rows(mine["centroid"].combine_chunks(), dim)))
            v = v.mapInArrow(_closer(shared), v.schema)
    known = lambda x: F.when(~F.isnan(x), F.col(x))
    return v.groupBy(F.col("label").alias(label_col)).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.round(F.avg(known("own")), 6).alias("mean_own_cosine"),
        F.round(F.avg(known("other")), 6).alias("mean_nearest_other_cosine"))
