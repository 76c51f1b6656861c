"""E1-E3, P12, E5, X1."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.clusters import cluster_report
from quire.operators.inference import (HashedBagEncoder, HashedIdsEncoder, embed, embed_tokens,
                                       first_token_pool, project_inputs)
from quire.session import scratch_path
from quire.sources import fixtures as fx
from quire.streaming.ingest import ingest_notes_stream

from conftest import SF_SMALL


def test_embed_text_batches_deterministic(spark):
    df = spark.createDataFrame([(i, f"w{i % 5} common text") for i in range(150)], "doc_id long, clinical_text string")
    a = {r.doc_id: r.embedding for r in embed(df, batch_size=64).collect()}
    b = {r.doc_id: r.embedding for r in embed(df.repartition(3), batch_size=7).collect()}
    assert len(a) == 150 and all(len(v) == 64 for v in a.values())
    assert all(np.allclose(a[k], b[k]) for k in a)
    assert np.allclose(a[0], a[5]) and not np.allclose(a[0], a[1])
    direct = HashedBagEncoder().make_predict_fn()(np.array(["w0 common text"]))[0]
    assert np.allclose(a[0], direct)


def test_embed_tokens_and_projection(spark):
    df = spark.createDataFrame([(1, [2, 7, 9, 3, 0], [1, 1, 1, 1, 0], [0] * 5)],
                               "doc_id long, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")
    assert "token_type_ids" not in project_inputs(df, HashedIdsEncoder()).columns
    e = embed_tokens(df, max_length=5).first().embedding
    assert len(e) == 64 and abs(np.linalg.norm(e) - 1) < 1e-6


def test_first_token_pool():
    h = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    assert first_token_pool(h).tolist() == [[0, 1, 2, 3], [12, 13, 14, 15]]


def test_cluster_report_separated_labels(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.label: r for r in cluster_report(df).collect()}
    assert got[0].mean_own_cosine == 1.0 and got[0].mean_nearest_other_cosine == 0.0
    assert got[1].n_vectors == 10


def test_cluster_report_counts_every_row(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 2.0], 0), (None, [3.0, 0.0], 0), (None, [3.0, 0.0], 0), (7, [0.0, 1.0], None),
            (8, None, 0), (9, [0.0, 0.0], None), (10, None, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block_bytes in (1 << 20, 16):
        got = {r.label: r for r in cluster_report(df, block_bytes=block_bytes).collect()}
        assert {k: r.n_vectors for k, r in got.items()} == {0: 5, None: 2, 5: 1}
        u = (1.75 ** 2 + 0.5 ** 2) ** 0.5   # centroid of 0: (7, 2) / 4
        assert got[0].mean_own_cosine == round((3 * 1.75 / u + 0.5 / u) / 4, 6)
        assert got[0].mean_nearest_other_cosine == 0.25 and got[None].mean_own_cosine == 1.0
        assert got[None].mean_nearest_other_cosine == round(0.5 / u, 6) and got[5].mean_own_cosine is None
    assert cluster_report(df.where("vec_id > 99")).count() == 0


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    docs = fx.table(spark, SF_SMALL, "documents")
    src = fx.render_notes(docs, scratch_path(spark, "t-src"), "discharge", n_files=3)
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    first = ingest_notes_stream(spark, src, sink, ckpt, "discharge").count()
    again = ingest_notes_stream(spark, src, sink, ckpt, "discharge").count()
    from quire.sources.notes import read_notes
    batch = read_notes(spark, src, "discharge")
    assert first == again == batch.count() == docs.where(F.col("lang").isin("en", "de")).count()
    s = ingest_notes_stream(spark, src, sink, ckpt, "discharge")
    assert s.exceptAll(batch.select("doc_id", "source", "clinical_text")).count() == 0


def test_stream_small_triggers_and_header_schema(spark, tmpdir_path):
    import os
    src = os.path.join(tmpdir_path, "notes")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"part{i}.csv"), "w") as f:
            f.write(f'note_id,text\n{i},"note  {i}\nline"\n')   # metadata columns absent
    sink, ckpt = scratch_path(spark, "t2-sink"), scratch_path(spark, "t2-ckpt")
    ingest_notes_stream(spark, src, sink, ckpt, "discharge", max_files_per_trigger=1)
    got = sorted((r.doc_id, r.clinical_text) for r in spark.read.parquet(sink).collect())
    assert got == [(0, "note 0 line"), (1, "note 1 line"), (2, "note 2 line")]
