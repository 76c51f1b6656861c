"""What Python workers hold of a batch."""

from pyspark.sql import functions as F

from quire.operators.tokens import ENCODE_CHARS, build_vocabulary, tokenize, tokenize_with

TEXTS = [(1, "b a b c"), (2, " a b "), (3, ""), (4, None), (5, "\n\n"), (6, "q " * 50 + "zz")]


def test_words_of_a_row_travel_as_one_string(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, clinical_text string")
    vocab = build_vocabulary(docs, vocab_size=None)
    ids = {r.token: r.token_id for r in vocab.collect()}
    t = tokenize(docs, vocab, 6)
    sent = t._jdf.queryExecution().optimizedPlan().toString()
    assert "lookup(array_join(" in sent
    got = {r.doc_id: (r.input_ids, r.n_tokens) for r in t.collect()}
    for k, text in TEXTS:
        words = (text or "").split()[:4]
        assert got[k] == ([2, *[ids[w] for w in words], 3] + [0] * (4 - len(words)), len(words) + 2)


def test_an_encoder_gets_slices_of_a_batch(spark):
    def encode(texts):
        assert len(texts) == 1 or sum(map(len, texts)) <= limit, "too much at once"
        return [[2, len(t), 3] for t in texts]

    limit = ENCODE_CHARS
    sizes = [0, limit // 2, limit // 2, limit // 2, 3 * limit, 7]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").coalesce(1).select(
        "doc_id", F.repeat(F.lit("x"), F.col("n")).alias("clinical_text"))
    got = {r.doc_id: r.input_ids for r in tokenize_with(docs, encode, 4).collect()}
    assert got == {k: [2, n, 3, 0] for k, n in enumerate(sizes)}
