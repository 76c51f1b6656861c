"""Masking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.masking import mask_probability, mask_tokens
from quire.operators.metrics import TOP_KS, argmax, top_indices, topk_report
from quire.operators.tokens import build_vocabulary, pad_vocabulary, tokenize
from quire.plans.queries_mix import _docs
from quire.plans.queries_tokens import SQL_VOCAB, sql_token_lists
from quire.plans.registry import register
from quire.sources.fixtures import table

SEED = 42
EPOCH = 0


def _u(draw: int) -> str:
    return (f"(('0x' || substr(md5(concat_ws(':', {SEED}, {EPOCH}, doc_id, i - 1, {draw})), 1, 8))::BIGINT"
            f" / 4294967296.0)")


SQL_P0 = "greatest(least(0.30::DOUBLE - (0.30::DOUBLE - 0.15::DOUBLE) * (0::DOUBLE / 49.0::DOUBLE), 1.0), 0.0)"
SQL_MASKED = f"""
SELECT doc_id, {EPOCH} AS epoch,
  list_transform(ids, lambda t, i: CASE WHEN NOT (t >= 5 AND {_u(0)} < {SQL_P0}) THEN t
                                        WHEN {_u(1)} < 0.8 THEN 4
                                        WHEN {_u(2)} < 0.5 THEN CAST(floor({_u(3)} * vsz) AS INTEGER)
                                        ELSE t END) AS ids,
  list_transform(ids, lambda t, i: CASE WHEN t >= 5 AND {_u(0)} < {SQL_P0} THEN t ELSE -100 END) AS labels
FROM ({sql_token_lists(128)}),
     (SELECT count(*) + (64 - count(*) % 64) % 64 AS vsz FROM ({SQL_VOCAB}))
"""


def _masked(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    vocab = build_vocabulary(docs)
    vsz = pad_vocabulary(vocab).count()
    tok = tokenize(docs, vocab, 128)
    ep = F.lit(EPOCH)
    return mask_tokens(tok, mask_probability(ep), ep, seed=SEED, vocab_size=vsz, method="md5")


@register("m2", f"SELECT doc_id, epoch, array_to_string(ids, ' ') AS input_ids, "
          f"array_to_string(labels, ' ') AS labels FROM ({SQL_MASKED})")
def q_m2(spark, sf_dir):
    m = _masked(spark, sf_dir)
    return m.select("doc_id", "epoch", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("labels", " ").alias("labels"))


@register("p11", f"SELECT doc_id, CAST(len(list_filter(labels, lambda l: l <> -100)) AS INTEGER) AS n_masked "
          f"FROM ({SQL_MASKED})")
def q_p11(spark, sf_dir):
    m = _masked(spark, sf_dir)
    return m.select("doc_id", F.size(F.filter("labels", lambda x: x != -100)).alias("n_masked"))


SQL_RANK = """
SELECT vec_id, label, embedding,
  len(list_filter(range(0, len(embedding)), lambda j: embedding[j + 1] > embedding[label + 1]
      OR (embedding[j + 1] = embedding[label + 1] AND j < label))) AS rk
FROM embeddings WHERE label <> -100
"""


@register("a6", "SELECT count(*) AS n_masked, CAST(0 AS BIGINT) AS n_invalid, " + ", ".join(
    f"avg(CASE WHEN rk < {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS top{k}_accuracy" for k in TOP_KS)
    + f" FROM ({SQL_RANK})")
def q_a6(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return topk_report(e, "embedding", "label", with_loss=False)


@register("a6_by_label", "SELECT label, count(*) AS n_masked, CAST(0 AS BIGINT) AS n_invalid, " + ", ".join(
    f"avg(CASE WHEN rk < {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS top{k}_accuracy" for k in TOP_KS)
    + f" FROM ({SQL_RANK}) GROUP BY label")
def q_a6_by_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return topk_report(e, "embedding", "label", group_cols=["label"], with_loss=False)


@register("a7", """
SELECT count(*) AS n_masked, round(avg(m + ln(s) - embedding[label + 1]::DOUBLE), 6) AS mlm_loss FROM (
  SELECT embedding, label, m,
         list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m))) AS s
  FROM (SELECT embedding, label, list_max(embedding)::DOUBLE AS m FROM embeddings WHERE label <> -100))
""")
def q_a7(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    r = topk_report(e, "embedding", "label", ks=(), with_loss=True)
    return r.select("n_masked", F.round("mlm_loss", 6).alias("mlm_loss"))


@register("w5", """
SELECT vec_id, CAST(tops[1] AS INTEGER) AS argmax, array_to_string(tops, ' ') AS top5 FROM (
  SELECT vec_id, list_transform(list_slice(list_sort(list_transform(embedding,
           lambda x, j: {'k': -x, 'i': j - 1})), 1, 5), lambda s: s.i) AS tops
  FROM embeddings)
""")
def q_w5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", argmax("embedding").alias("argmax"),
                    F.array_join(top_indices("embedding", 5), " ").alias("top5"))


@register("a6_invalid", f"""
SELECT count(*) AS n_masked, count(*) FILTER (WHERE vec_id % 10 = 0) AS n_invalid,
       avg(CASE WHEN vec_id % 10 <> 0 THEN (CASE WHEN rk < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END) AS top5_accuracy
FROM ({SQL_RANK})
""")
def q_a6_invalid(spark, sf_dir):
    """A6 with every tenth label outside its vector: counted, not scored."""
    e = table(spark, sf_dir, "embeddings")
    e = e.withColumn("label", F.when(F.col("vec_id") % 10 == 0, F.size("embedding") + 3).otherwise(F.col("label")))
    return topk_report(e, "embedding", "label", ks=(5,), with_loss=False)
