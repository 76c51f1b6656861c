"""Tokenisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.tokens import (DEFAULT_VOCAB_SIZE, SPECIALS, batch_padding,
                                    build_vocabulary, dynamic_pad, pad_vocabulary, token_counts,
                                    tokenize)
from quire.operators.ordering import with_positions
from quire.plans.queries_mix import _docs
from quire.plans.registry import register, sql_clean
from quire.session import scratch_path
from quire.sources.sinks import write_tokenized

_SPECIAL_ROWS = ", ".join(f"('{t}', {i}, NULL::BIGINT)" for i, t in enumerate(SPECIALS))
SQL_VOCAB = f"""
SELECT token, CAST(rk + {len(SPECIALS)} AS INTEGER) AS token_id, cnt AS count FROM (
  SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS rk FROM (
    SELECT token, count(*) AS cnt FROM (
      SELECT unnest(string_split({sql_clean('text')}, ' ')) AS token FROM documents)
    WHERE token <> '' GROUP BY token))
WHERE rk < {DEFAULT_VOCAB_SIZE - len(SPECIALS)}
UNION ALL SELECT * FROM (VALUES {_SPECIAL_ROWS}) s(token, token_id, count)
"""


def sql_token_lists(max_length: int) -> str:
    keep = max_length - 2
    return f"""
WITH v AS ({SQL_VOCAB}),
d AS (SELECT doc_id, list_slice(list_filter(string_split({sql_clean('text')}, ' '), lambda x: x <> ''), 1, {keep}) AS toks
      FROM documents),
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM d),
m AS (SELECT e.doc_id, e.i, coalesce(v.token_id, 1) AS tid FROM e LEFT JOIN v ON e.tok = v.token),
g AS (SELECT doc_id, list(tid ORDER BY i) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(coalesce(g.ids, []::INTEGER[])) + 2 AS INTEGER) AS n_tokens,
       list_resize(list_concat([2], coalesce(g.ids, []::INTEGER[]), [3]), {max_length}, 0) AS ids
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def sql_tokenized(max_length: int) -> str:
    return (f"SELECT doc_id, n_tokens, array_to_string(ids, ' ') AS input_ids "
            f"FROM ({sql_token_lists(max_length)})")


@register("t8", SQL_VOCAB)
def q_t8(spark, sf_dir):
    return build_vocabulary(_docs(spark, sf_dir))


@register("t7", f"""
WITH v AS ({SQL_VOCAB}), n AS (SELECT CAST(count(*) AS INTEGER) AS n FROM v)
SELECT * FROM v UNION ALL
SELECT '<dummy_extra_token_' || i || '>' AS token, CAST(n + i AS INTEGER) AS token_id, NULL::BIGINT AS count
FROM (SELECT n, unnest(range(0, (64 - n % 64) % 64)) AS i FROM n)
""")
def q_t7(spark, sf_dir):
    return pad_vocabulary(build_vocabulary(_docs(spark, sf_dir)))


def _tokenized(spark, sf_dir, max_length):
    docs = _docs(spark, sf_dir)
    t = tokenize(docs, build_vocabulary(docs), max_length)
    return t.select("doc_id", "n_tokens", F.array_join("input_ids", " ").alias("input_ids"))


@register("t9", sql_tokenized(128))
def q_t9(spark, sf_dir):
    return _tokenized(spark, sf_dir, 128)


@register("t9_arrow", sql_tokenized(128))
def q_t9_arrow(spark, sf_dir):
    """T9's Arrow-batch lookup, which is now the only one (kept as a query)."""
    return _tokenized(spark, sf_dir, 128)


@register("t10", sql_tokenized(512))
def q_t10(spark, sf_dir):
    return _tokenized(spark, sf_dir, 512)


@register("s8", f"SELECT doc_id, n_tokens FROM ({sql_tokenized(128)})")
def q_s8(spark, sf_dir):
    """Tokenised dataset written (``__`` columns dropped, P4) and read back."""
    docs = _docs(spark, sf_dir)
    t = tokenize(docs, build_vocabulary(docs), 128).withColumn("__index_level_0__", F.lit(0))
    path = write_tokenized(t, scratch_path(spark, "tokenized"))
    back = spark.read.parquet(path)
    assert not [c for c in back.columns if c.startswith("__")]
    return back.select("doc_id", "n_tokens")


@register("w4", f"""
SELECT doc_id, batch_id, n_tokens, max(n_tokens) OVER (PARTITION BY batch_id) AS padded_length FROM (
  SELECT doc_id, CAST(floor(pos / 64) AS BIGINT) AS batch_id,
         CAST(least(len(list_filter(string_split({sql_clean('text')}, ' '), lambda x: x <> '')) + 2, 512) AS INTEGER)
           AS n_tokens
  FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text FROM documents))
""")
def q_w4(spark, sf_dir):
    docs = with_positions(token_counts(_docs(spark, sf_dir), 512), ["doc_id"])
    return batch_padding(docs, 64, 512).select("doc_id", "batch_id", "n_tokens", "padded_length")


@register("w4_arrays", f"""
WITH t AS ({sql_token_lists(512)}),
p AS (SELECT t.*, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 64) AS BIGINT) AS batch_id FROM t),
m AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS padded_length FROM p)
SELECT doc_id, batch_id, padded_length, array_to_string(list_slice(ids, 1, padded_length), ' ') AS input_ids,
       n_tokens AS n_mask FROM m
""")
def q_w4_arrays(spark, sf_dir):
    """W4 on the arrays themselves: batches cut to their longest member."""
    docs = _docs(spark, sf_dir)
    t = with_positions(tokenize(docs, build_vocabulary(docs), 512), ["doc_id"])
    return dynamic_pad(t, 64).select(
        "doc_id", "batch_id", "padded_length", F.array_join("input_ids", " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))


_EDGES = ("CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[MASK] [PAD] <dummy_extra_token_0> ' || {t} "
          "WHEN 2 THEN '' ELSE {t} END")


@register("t9_edges", f"""
WITH docs AS (SELECT doc_id, {_EDGES.format(t=sql_clean('text'))} AS t FROM documents),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 4 AS INTEGER) AS token_id FROM (
  SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(t, ' ')) AS token FROM docs)
  WHERE token NOT IN ('', {', '.join(f"'{t}'" for t in SPECIALS)}) AND token NOT LIKE '<dummy_extra_token_%>'
  GROUP BY token) QUALIFY token_id < {DEFAULT_VOCAB_SIZE}),
d AS (SELECT doc_id, list_slice(list_filter(string_split(coalesce(t, ''), ' '), lambda x: x <> ''), 1, 30) AS toks FROM docs),
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM d),
g AS (SELECT doc_id, list(coalesce(token_id, 1) ORDER BY i) AS ids FROM e LEFT JOIN v ON tok = token GROUP BY doc_id)
SELECT doc_id % 7 AS doc_id, 32 AS width, CAST(len(coalesce(ids, []::INTEGER[])) + 2 AS INTEGER) AS n_tokens,
       array_to_string(list_resize(list_concat([2], coalesce(ids, []::INTEGER[]), [3]), 32, 0), ' ') AS input_ids
FROM d LEFT JOIN g USING (doc_id)
""")
def q_t9_edges(spark, sf_dir):
    """T9 with special tokens in texts, null and empty texts, and equal ids."""
    t = F.col("clinical_text")
    docs = _docs(spark, sf_dir).withColumn("clinical_text", F.when(F.col("doc_id") % 5 == 0, None).when(
        F.col("doc_id") % 5 == 1, F.concat(F.lit("[MASK] [PAD] <dummy_extra_token_0> "), t)).when(
        F.col("doc_id") % 5 == 2, "").otherwise(t))
    out = tokenize(docs.withColumn("doc_id", F.col("doc_id") % 7), build_vocabulary(docs), 32)
    return out.select("doc_id", F.size("input_ids").alias("width"), "n_tokens", F.array_join("input_ids", " ").alias("input_ids"))


@register("f2", sql_tokenized(128))
def q_f2(spark, sf_dir):
    """a pluggable tokenizer (Rust WordLevel over the same vocabulary)
    applied in Arrow batches; ids equal T9's."""
    from quire.operators.tokens import tokenize_with, wordlevel_encoder
    docs = _docs(spark, sf_dir)
    enc = wordlevel_encoder(build_vocabulary(docs), 128)
    t = tokenize_with(docs, enc, 128)
    return t.select("doc_id", "n_tokens", F.array_join("input_ids", " ").alias("input_ids"))
