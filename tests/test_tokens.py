"""Vocabulary, padding, tokenisation."""

from pyspark.sql import functions as F

from quire.operators.ordering import with_positions
from quire.operators.tokens import (CLS_ID, PAD_ID, SEP_ID, UNK_ID, batch_padding, build_vocabulary,
                                    dynamic_pad, pad_vocabulary, tokenize, tokenize_with,
                                    wordlevel_encoder)

TEXTS = [(1, "b a b c"), (2, "a b"), (3, ""), (4, "d d d d e"), (5, "zz")]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, clinical_text string")


def test_vocabulary_rank_and_cap(spark):
    v = {r.token: r.token_id for r in build_vocabulary(_docs(spark), vocab_size=None).collect()}
    # counts: d4 b3 a2 c1 e1 zz1 -> ties by token
    assert v == {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "[MASK]": 4,
                 "d": 5, "b": 6, "a": 7, "c": 8, "e": 9, "zz": 10}
    capped = build_vocabulary(_docs(spark), vocab_size=8)
    assert sorted(r.token_id for r in capped.collect()) == list(range(8))


def test_vocabulary_padding(spark):
    v = build_vocabulary(_docs(spark), vocab_size=None)
    p = pad_vocabulary(v, 64).collect()
    assert len(p) == 64 and sorted(r.token_id for r in p) == list(range(64))
    assert {r.token for r in p if r.token_id == 11} == {"<dummy_extra_token_0>"}
    v64 = pad_vocabulary(pad_vocabulary(v, 64), 64)
    assert v64.count() == 64


def test_tokenize_truncate_pad_unknown(spark):
    docs = _docs(spark)
    vocab = build_vocabulary(docs, vocab_size=8)          # d b a : c e zz are unknown
    t = {r.doc_id: r for r in tokenize(docs, vocab, 5).collect()}
    assert t[1].input_ids == [CLS_ID, 6, 7, 6, SEP_ID] and t[1].n_tokens == 5
    assert t[2].input_ids == [CLS_ID, 7, 6, SEP_ID, PAD_ID] and list(t[2].attention_mask) == [1, 1, 1, 1, 0]
    assert t[3].input_ids == [CLS_ID, SEP_ID, PAD_ID, PAD_ID, PAD_ID] and t[3].n_tokens == 2
    assert t[5].input_ids == [CLS_ID, UNK_ID, SEP_ID, PAD_ID, PAD_ID]


def test_user_tokenizer_matches_builtin(spark):
    docs = _docs(spark)
    vocab = build_vocabulary(docs, vocab_size=8)
    a = {r.doc_id: r.input_ids for r in tokenize(docs, vocab, 6).collect()}
    b = {r.doc_id: r.input_ids for r in tokenize_with(docs, wordlevel_encoder(vocab, 6), 6).collect()}
    assert a == b


def test_dynamic_batch_padding(spark):
    docs = with_positions(spark.createDataFrame(
        [(i, " ".join(["w"] * (i % 7))) for i in range(10)], "doc_id long, clinical_text string"), ["doc_id"])
    out = {r.doc_id: (r.batch_id, r.n_tokens, r.padded_length) for r in batch_padding(docs, 4, 6).collect()}
    assert out[0] == (0, 2, 5) and out[3] == (0, 5, 5) and out[5] == (1, 6, 6) and out[8] == (2, 3, 4)


def test_dynamic_pad_arrays(spark):
    docs = _docs(spark)
    t = with_positions(tokenize(docs, build_vocabulary(docs, vocab_size=None), 8), ["doc_id"])
    out = {r.doc_id: r for r in dynamic_pad(t, 2).collect()}
    # batches by position: (1,2) (3,4) (5)
    assert len(out[1].input_ids) == 6 and len(out[2].input_ids) == 6
    assert len(out[3].input_ids) == 7 and out[3].input_ids[:2] == [CLS_ID, SEP_ID]
    assert out[5].input_ids == [CLS_ID, 10, SEP_ID] and list(out[5].attention_mask) == [1, 1, 1]


def test_special_tokens_null_texts_and_equal_ids(spark):
    docs = spark.createDataFrame([(1, "[MASK] a [PAD] a"), (1, "a <dummy_extra_token_3>"), (None, None), (2, "")],
                                 "doc_id long, clinical_text string")
    vocab = build_vocabulary(docs, vocab_size=None)
    tokens = [r.token for r in vocab.collect()]
    assert len(tokens) == len(set(tokens)) == 6
    rows = tokenize(docs, vocab, 5).collect()
    assert len(rows) == 4 and {len(r.input_ids) for r in rows} == {5}
    assert sorted(r.input_ids for r in rows) == sorted([
        [CLS_ID, UNK_ID, 5, UNK_ID, SEP_ID], [CLS_ID, 5, UNK_ID, SEP_ID, PAD_ID], [CLS_ID, SEP_ID, PAD_ID, PAD_ID, PAD_ID],
        [CLS_ID, SEP_ID, PAD_ID, PAD_ID, PAD_ID]])
    assert all(r.n_tokens == sum(r.attention_mask) for r in rows)
