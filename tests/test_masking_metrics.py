"""M2 invariants; A6/A7/W5/P11 metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.masking import IGNORE, mask_tokens
from quire.operators.metrics import argmax, masked_only, top_indices, topk_report


def _tokens(spark, n_docs=200, width=64, seed=1):
    rnd = random.Random(seed)
    rows = []
    for d in range(n_docs):
        n = rnd.randint(0, width - 2)
        ids = [2] + [rnd.randint(5, 999) for _ in range(n)] + [3] + [0] * (width - n - 2)
        rows.append((d, ids))
    return spark.createDataFrame(rows, "doc_id long, input_ids array<int>")


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_mask_invariants(spark, method):
    df = _tokens(spark)
    out = mask_tokens(df, 0.3, 0, seed=7, vocab_size=1000, method=method).collect()
    orig = {r.doc_id: r.input_ids for r in df.collect()}
    chosen = eligible = 0
    for r in out:
        o = orig[r.doc_id]
        for t, new, lab in zip(o, r.input_ids, r.labels):
            if t < 5:
                assert new == t and lab == IGNORE          # specials untouched
            else:
                eligible += 1
            if lab != IGNORE:
                chosen += 1
                assert lab == t
            else:
                assert new == t                            # unchosen never change
    p, n = 0.3, eligible
    assert abs(chosen - p * n) <= 4 * math.sqrt(n * p * (1 - p))


def test_mask_p0_p1_and_determinism(spark):
    df = _tokens(spark, 50)
    none = mask_tokens(df, 0.0, 3).collect()
    assert all(all(l == IGNORE for l in r.labels) for r in none)
    full = mask_tokens(df, 1.0, 3).collect()
    assert all(all((l != IGNORE) == (t >= 5) for t, l in zip(o, r.labels))
               for r, o in zip(sorted(full, key=lambda r: r.doc_id),
                               [x.input_ids for x in sorted(df.collect(), key=lambda r: r.doc_id)]))
    a = {r.doc_id: (r.input_ids, r.labels) for r in mask_tokens(df, 0.3, 2).collect()}
    b = {r.doc_id: (r.input_ids, r.labels) for r in mask_tokens(df.repartition(7), 0.3, 2).collect()}
    c = {r.doc_id: (r.input_ids, r.labels) for r in mask_tokens(df, 0.3, 4).collect()}
    assert a == b and a != c


def test_mask_rows_of_specials_only(spark):
    df = spark.createDataFrame([(1, [2, 3, 0, 0])], "doc_id long, input_ids array<int>")
    r = mask_tokens(df, 1.0, 0).first()
    assert r.input_ids == [2, 3, 0, 0] and r.labels == [IGNORE] * 4


def _numpy_rank(scores, label):
    s = np.asarray(scores)
    return int(((s > s[label]) | ((s == s[label]) & (np.arange(len(s)) < label))).sum())


def test_topk_ties_and_large_k(spark):
    rows = [(0, [1.0, 1.0, 1.0], 2), (1, [0.5, 2.0, 2.0], 2), (2, [3.0, 1.0], 1), (3, [1.0, 2.0], IGNORE)]
    df = spark.createDataFrame(rows, "id long, scores array<float>, label int")
    r = topk_report(df, ks=(1, 2, 5)).first()
    ranks = [_numpy_rank(s, l) for _, s, l in rows[:3]]
    assert ranks == [2, 1, 1]
    assert r.n_masked == 3
    assert r.top1_accuracy == 0.0 and r.top2_accuracy == pytest.approx(2 / 3) and r.top5_accuracy == 1.0


def test_loss_matches_numpy_and_no_masked_rows(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rnd.normal(0, 30, 16)], int(rnd.integers(0, 16))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, scores array<double>, label int")
    got = topk_report(df).first().mlm_loss
    exp = np.mean([np.logaddexp.reduce(np.array(s)) - s[l] for _, s, l in rows])
    assert got == pytest.approx(exp, rel=1e-12)
    none = spark.createDataFrame([(0, [1.0], IGNORE)], "id long, scores array<double>, label int")
    r = topk_report(none).first()
    assert r.n_masked == 0 and r.top1_accuracy is None and r.mlm_loss is None
    assert masked_only(none).count() == 0


def test_argmax_and_top_indices(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9, 0.3],)], "s array<float>")
    r = df.select(argmax("s").alias("a"), top_indices("s", 3).alias("t"), top_indices("s", 9).alias("all")).first()
    assert r.a == 1 and r.t == [1, 2, 3] and r.all == [1, 2, 3, 0]


def test_array_helpers(spark):
    from quire.functions.arrays import pad_right, topk_hit
    df = spark.createDataFrame([([1, 2, 3], [0.1, 0.7, 0.2], 2)], "a array<int>, s array<double>, l int")
    r = df.select(pad_right("a", 5, 0).alias("p"), pad_right("a", 2, 0).alias("t"),
                  topk_hit("s", "l", 1).alias("h1"), topk_hit("s", "l", 2).alias("h2")).first()
    assert r.p == [1, 2, 3, 0, 0] and r.t == [1, 2] and r.h1 == 0.0 and r.h2 == 1.0
