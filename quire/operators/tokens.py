"""Vocabulary (T7, T8), tokenisation (T9, T10), dynamic padding.

The reference's pretrained tokenizer files are not available, so the
built-in tokenizer is word-level: whitespace tokens, a vocabulary ranked by
(count desc, token asc) with special ids first and a fixed size (a model
parameter, which also bounds the broadcast).  Lengths, truncation, padding
and masks behave like the reference's; ids differ.  A user tokenizer plugs
in through ``tokenize_with`` (Arrow batches, F2).

Words equal to a special or dummy token are never counted into the vocabulary
and become ``[UNK]``, so every token has one id.  ``tokenize`` truncates the word
list first, so work per row is bounded by ``max_length``, and looks ids up in
Arrow batches against the vocabulary, shipped once per executor: no shuffle, no
regrouping by a user's key, so equal or null keys keep their rows.  A null text is
an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import first_words, split_words
from quire.operators.ordering import assign_batches, with_positions
from quire.session import materialize as _materialize

# Special tokens and their ids; default vocabulary size (the
# size of the common uncased BERT vocabulary) and padding multiple.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = range(5)
DEFAULT_VOCAB_SIZE = 30522
VOCAB_MULTIPLE = 64
LOOKUP_ROWS = 500            # rows that are Python objects at a time
ENCODE_CHARS = 1 << 20      # characters of text a user tokenizer gets at once
DUMMY_TOKEN = "<dummy_extra_token_%d>"


def _specials(spark) -> DataFrame:
    return spark.createDataFrame([(t, i, None) for i, t in enumerate(SPECIALS)],
                                 "token string, token_id int, count long")


def reserved(token: Column) -> Column:
    """Whether a word is the name of a special or dummy token."""
    return token.isin(SPECIALS) | token.rlike("^" + DUMMY_TOKEN.replace("%d", "[0-9]+") + "$")


def build_vocabulary(df: DataFrame, text_col: str = "clinical_text",
                     vocab_size: int | None = DEFAULT_VOCAB_SIZE, materialize: bool = True) -> DataFrame:
    """(token, token_id, count); specials take ids 0..4.

    The vocabulary is a model artifact read by every tokenisation pass, so
    by default it is written once (size bounded by ``vocab_size``)."""
    words = df.select(F.explode(split_words(F.col(text_col))).alias("token"))
    counts = _materialize(words.groupBy("token").agg(F.count(F.lit(1)).alias("count")), "token-counts")
    counts = counts.where(~reserved(F.col("token")))  # tested once per distinct word
    if vocab_size is not None:
        keep = vocab_size - len(SPECIALS)
        counts = counts.where(F.col("count") >= F.lit(_count_threshold(counts, keep)))
    ranked = with_positions(counts.withColumn("__neg", -F.col("count")), ["__neg", "token"], "__rank")
    if vocab_size is not None:
        ranked = ranked.where(F.col("__rank") < F.lit(keep))
    words_v = ranked.select("token", (F.col("__rank") + len(SPECIALS)).cast("int").alias("token_id"), "count")
    vocab = _specials(df.sparkSession).unionByName(words_v)
    return _materialize(vocab, "vocab") if materialize else vocab


def _count_threshold(counts: DataFrame, keep: int) -> int:
    """Largest count c with at least ``keep`` tokens of count >= c (or the
    smallest count when there are fewer tokens).  Only tokens at or above
    it can make the top ``keep``, so ranking touches about ``keep`` + ties
    rows instead of every distinct token.  Works on the histogram of counts,
    which has at most sqrt(2 * words) rows."""
    from pyspark.sql import Window
    hist = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    cum = hist.withColumn("above", F.sum("n").over(
        Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0)))
    row = cum.where(F.col("above") >= F.lit(keep)).agg(F.max("count").alias("c")).first()
    if row is None or row["c"] is None:
        return 0
    return int(row["c"])


def pad_vocabulary(vocab: DataFrame, multiple: int = VOCAB_MULTIPLE) -> DataFrame:
    """Append ``<dummy_extra_token_i>`` until the size is a multiple."""
    n = vocab.agg(F.count(F.lit(1)).cast("int").alias("n"))
    pad = F.pmod(F.lit(multiple) - F.pmod(F.col("n"), F.lit(multiple)), F.lit(multiple))
    idx = F.when(pad > 0, F.sequence(F.lit(0), pad - 1)).otherwise(F.array().cast("array<int>"))
    dummies = n.select("n", F.explode(idx).alias("i")).select(
        F.format_string(DUMMY_TOKEN, F.col("i")).alias("token"),
        (F.col("n") + F.col("i")).cast("int").alias("token_id"),
        F.lit(None).cast("long").alias("count"))
    return vocab.unionByName(dummies)


def truncated_words(text: Column, max_length: int) -> Column:
    return first_words(text, max(0, max_length - 2))


def frame_ids(ids: Column, max_length: int | None) -> tuple[Column, Column, Column]:
    """[CLS] ids [SEP] [PAD]... -> (input_ids, attention_mask, n_tokens)."""
    full = F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)))
    n = F.size(ids) + 2
    if max_length is None:
        return full, F.array_repeat(F.lit(1).cast("tinyint"), n), n
    pad = F.greatest(F.lit(max_length) - n, F.lit(0))
    input_ids = F.concat(full, F.array_repeat(F.lit(PAD_ID), pad))
    mask = F.concat(F.array_repeat(F.lit(1).cast("tinyint"), n),
                    F.array_repeat(F.lit(0).cast("tinyint"), pad))
    return input_ids, mask, n


def tokenize(df: DataFrame, vocab: DataFrame, max_length: int = 128,
             text_col: str = "clinical_text", id_col: str = "doc_id") -> DataFrame:
    """(id, input_ids, attention_mask, n_tokens), ``max_length`` wide;
    one row per input row."""
    spark = df.sparkSession
    # bounded by the vocabulary size (a model parameter)
    words = vocab.where(~reserved(F.col("token"))).select("token", "token_id")
    bc = spark.sparkContext.broadcast({r["token"]: r["token_id"] for r in words.collect()})

    @F.arrow_udf("array<int>")
    def lookup(lines: pa.Array) -> pa.Array:
        d = bc.value
        return pa.concat_arrays([
            pa.array([[d.get(w, UNK_ID) for w in x.split(" ")] if x else [] for x in lines.slice(i, LOOKUP_ROWS).to_pylist()],
                     pa.list_(pa.int32())) for i in range(0, max(1, len(lines)), LOOKUP_ROWS)])

    # words hold no space: one string a row, as a batch of single words takes many times the memory
    text = F.coalesce(F.col(text_col), F.lit(""))
    input_ids, mask, n = frame_ids(lookup(F.array_join(truncated_words(text, max_length), " ")), max_length)
    return df.select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"),
                     n.alias("n_tokens"))


def slices_by_chars(texts, limit: int = ENCODE_CHARS):
    """Lists of neighbouring texts of ``limit`` characters or less each; one
    longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def tokenize_with(df: DataFrame, encode, max_length: int = 128,
                  text_col: str = "clinical_text", id_col: str = "doc_id") -> DataFrame:
    """a user tokenizer ``encode(list[str]) -> list[list[int]]`` (already
    framed with its own specials) applied in Arrow batches, padded here.  A call
    gets texts of about ``ENCODE_CHARS`` characters, as what an encoder makes of
    them takes many times their memory."""

    @F.pandas_udf("array<int>")
    def enc(texts: pd.Series) -> pd.Series:
        out = []
        for part in slices_by_chars(texts):
            out += [np.array(list(x)[:max_length], np.int32) for x in encode(part)]
        return pd.Series(out)

    ids = enc(F.coalesce(F.col(text_col), F.lit("")))
    n = F.size(ids)
    pad = F.greatest(F.lit(max_length) - n, F.lit(0))
    return df.select(id_col, F.concat(ids, F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
                     F.concat(F.array_repeat(F.lit(1).cast("tinyint"), n),
                              F.array_repeat(F.lit(0).cast("tinyint"), pad)).alias("attention_mask"),
                     n.alias("n_tokens"))


def token_counts(df: DataFrame, max_length: int = 512, text_col: str = "clinical_text") -> DataFrame:
    """``n_tokens`` (after truncation) in place of the text, ahead of numbering
    and batching, so that text is not shuffled to get one number a row."""
    n = F.least(F.size(split_words(F.coalesce(F.col(text_col), F.lit("")))) + 2, F.lit(max_length))
    return df.withColumn("n_tokens", n.cast("int")).drop(text_col)


def batch_padding(df: DataFrame, batch_size: int = 64, max_length: int = 512,
                  text_col: str = "clinical_text", pos_col: str = "pos") -> DataFrame:
    """W3 + W4: contiguous batches; each row padded to the longest member of
    its batch after truncation at ``max_length``.  Batches are bounded
    (``batch_size`` rows), so the per-batch max is a small window.  Takes rows
    with ``n_tokens`` or, failing that, with text."""
    from pyspark.sql import Window
    counted = df if "n_tokens" in df.columns else token_counts(df, max_length, text_col)
    b = assign_batches(counted, batch_size, pos_col)
    return b.withColumn("padded_length", F.max("n_tokens").over(Window.partitionBy("batch_id")))


def wordlevel_encoder(vocab: DataFrame, max_length: int = 128):
    """A user-style tokenizer for ``tokenize_with``: the Rust ``tokenizers``
    WordLevel model over this vocabulary, whitespace pre-split, framed by
    [CLS]/[SEP], truncated to ``max_length``.  Built lazily once per Python
    worker from the (size-bounded) vocabulary map."""
    table = {r["token"]: int(r["token_id"]) for r in vocab.select("token", "token_id").collect()}
    state = {}

    def encode(texts):
        tok = state.get("tok")
        if tok is None:
            from tokenizers import Tokenizer, models, pre_tokenizers, processors
            tok = Tokenizer(models.WordLevel(table, unk_token=SPECIALS[UNK_ID]))
            tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            tok.post_processor = processors.TemplateProcessing(
                single=f"{SPECIALS[CLS_ID]} $A {SPECIALS[SEP_ID]}",
                special_tokens=[(SPECIALS[CLS_ID], CLS_ID), (SPECIALS[SEP_ID], SEP_ID)])
            tok.enable_truncation(max_length=max_length)
            state["tok"] = tok
        return [e.ids for e in tok.encode_batch(["" if t is None else t for t in texts])]
    return encode


def dynamic_pad(tokenized: DataFrame, batch_size: int = 64, pos_col: str = "pos") -> DataFrame:
    """W4 on token arrays: fixed-width rows (``tokenize`` output with a
    position column) cut to the longest member of their batch."""
    from pyspark.sql import Window
    b = assign_batches(tokenized, batch_size, pos_col)
    b = b.withColumn("padded_length", F.max("n_tokens").over(Window.partitionBy("batch_id")))
    return (b.withColumn("input_ids", F.slice("input_ids", 1, F.col("padded_length")))
             .withColumn("attention_mask", F.slice("attention_mask", 1, F.col("padded_length"))))
