"""Inference queries (E1, E2, E3, E5) and streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.clusters import cluster_report
from quire.operators.inference import embed, embed_tokens, first_token_column
from quire.operators.patients import patient_documents
from quire.operators.tokens import build_vocabulary, tokenize
from quire.plans.queries_corpus import SQL_FILLED, _patients, sql_articles, sql_note
from quire.plans.queries_mix import _docs
from quire.plans.queries_tokens import sql_token_lists
from quire.plans.registry import register
from quire.session import scratch_path
from quire.sources import fixtures as fx
from quire.sources.fixtures import table
from quire.streaming.ingest import ingest_articles_stream, ingest_notes_stream


def _sql_bags(rows: str, key: str) -> str:
    """Signed hashed bags (64 places, four digits) of ``rows``: key, toks (null
    toks: null embedding)."""
    return f"""
WITH r AS ({rows}),
t AS (SELECT {key}, unnest(toks) AS tok FROM r),
h AS (SELECT {key}, CAST('0x' || substr(md5(CAST(tok AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM t),
s AS (SELECT {key}, h % 64 AS d, sum(CASE WHEN (h // 64) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM s GROUP BY 1),
f AS (SELECT r.{key}, r.toks IS NULL AS none, g.d FROM r, (SELECT unnest(range(0, 64)) AS d) g)
SELECT f.{key}, CASE WHEN NOT any_value(f.none) THEN string_agg(
         CAST(CAST(round(coalesce(s.v / nullif(n.n, 0), 0) * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY f.d) END AS embedding
FROM f LEFT JOIN s ON s.{key} = f.{key} AND s.d = f.d LEFT JOIN n ON n.{key} = f.{key} GROUP BY f.{key}
"""


def _four_digits(embedding: str = "embedding"):
    return F.array_join(F.transform(embedding, lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",")


_SQL_INFO = """SELECT patient_id, CASE WHEN info IS NOT NULL THEN list_slice(list_filter(
  regexp_split_to_array(info, '\\s+'), lambda x: x <> ''), 1, 510) END AS toks FROM (
  SELECT patient_id, arrival || codes || triage || vitals || pyxis || medrecon AS info FROM ({filled}))"""


@register("e1", _sql_bags(_SQL_INFO.format(filled=SQL_FILLED), "patient_id"))
def q_e1(spark, sf_dir):
    """Patient documents (E4) embedded in batches of 64 with the stand-in
    encoder; patients without a complete document keep a null embedding."""
    docs = patient_documents(_patients(spark, sf_dir))
    return embed(docs, batch_size=64, text_col="info", id_col="patient_id").select("patient_id", _four_digits().alias("embedding"))


@register("e2", _sql_bags(f"SELECT doc_id, list_filter(list_slice(ids, 1, n_tokens), lambda x: x >= 5) AS toks "
                          f"FROM ({sql_token_lists(512)})", "doc_id"))
def q_e2(spark, sf_dir):
    """Pre-tokenised documents (T10, 512) embedded from ids + mask; the input
    type the encoder does not take is dropped (P12)."""
    docs = _docs(spark, sf_dir)
    tok = tokenize(docs, build_vocabulary(docs), 512).withColumn(
        "token_type_ids", F.array_repeat(F.lit(0), 512))
    return embed_tokens(tok, batch_size=64, max_length=512).select("doc_id", _four_digits().alias("embedding"))


_E3 = ", ".join(f"embedding[{i + 1}] AS d{i}" for i in range(8))


@register("e3", f"SELECT vec_id, {_E3} FROM embeddings")
def q_e3(spark, sf_dir):
    """First-token pooling of hidden states stored flat as 8 tokens x 8 dims."""
    e = table(spark, sf_dir, "embeddings")
    first = first_token_column("embedding", 8)
    return e.select("vec_id", *[F.get(first, i).alias(f"d{i}") for i in range(8)])


_E5 = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS vec_id, label, embedding FROM embeddings),
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS d FROM e),
c AS (SELECT label, d, avg(v) AS c FROM x GROUP BY label, d),
dots AS (SELECT x.vec_id, x.label, c.label AS cl, sum(x.v * c.c) AS dot FROM x JOIN c ON x.d = c.d GROUP BY 1, 2, 3),
vn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY 1),
cn AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1),
cs AS (SELECT dots.vec_id, dots.label, dots.cl, dot / (vn.n * cn.n) AS s
       FROM dots JOIN vn ON vn.vec_id = dots.vec_id JOIN cn ON cn.label = dots.cl),
per AS (SELECT vec_id, label, max(CASE WHEN cl = label THEN s END) AS own,
               max(CASE WHEN cl <> label THEN s END) AS other FROM cs GROUP BY 1, 2)
SELECT label, count(*) AS n_vectors, round(avg(own), 6) AS mean_own_cosine,
       round(avg(other), 6) AS mean_nearest_other_cosine
FROM per GROUP BY label
"""


@register("e5", _E5)
def q_e5(spark, sf_dir):
    return cluster_report(table(spark, sf_dir, "embeddings"))


@register("e5_equal_ids", _E5.replace("label, embedding FROM embeddings", "vec_id % 40 - 10 AS label, embedding FROM embeddings"))
def q_e5_equal_ids(spark, sf_dir):
    """E5 of vectors that share ids or have none, over more labels: every row counts."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select(F.nullif(F.col("vec_id") % 3, F.lit(1)).alias("vec_id"), (F.col("vec_id") % 40 - 10).alias("label"), "embedding")
    return cluster_report(e, block_bytes=5000)


@register("x1", sql_note("discharge", None) + " UNION ALL " + sql_note("radiology", None))
def q_x1(spark, sf_dir):
    """Notes ingested incrementally (file stream -> Parquet sink); run twice
    on one checkpoint to show a restart adds nothing."""
    docs = fx.table(spark, sf_dir, "documents")
    out = None
    for src in fx.NOTE_SOURCES:
        src_dir = fx.render_notes(docs, scratch_path(spark, f"stream-src-{src}"), src, n_files=4)
        sink, ckpt = scratch_path(spark, f"stream-sink-{src}"), scratch_path(spark, f"stream-ckpt-{src}")
        ingest_notes_stream(spark, src_dir, sink, ckpt, src)
        df = ingest_notes_stream(spark, src_dir, sink, ckpt, src)
        out = df if out is None else out.unionByName(df)
    return out


@register("x1_articles", sql_articles(None))
def q_x1_articles(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    src_dir = fx.render_articles(docs, scratch_path(spark, "stream-src-articles"))
    return ingest_articles_stream(spark, src_dir, scratch_path(spark, "stream-sink-articles"),
                                  scratch_path(spark, "stream-ckpt-articles"))
