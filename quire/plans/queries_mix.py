"""Mixing queries: packing (G1), upsampling (G2), membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import clean_text
from quire.operators.joins import with_membership
from quire.operators.packing import pack_contexts
from quire.operators.sampling import upsample
from quire.plans.registry import register, sql_clean
from quire.sources.fixtures import table

PACK_T = 8192


def _pack_sql(scope: str | None, order: str = "doc_id", src: str = "source", label: bool = True) -> str:
    """Next-fit as a recursive walk; ``scope`` is the SQL of the scope column."""
    first = f"{scope} NULLS FIRST, " if scope else ""
    same = "s.g IS NOT DISTINCT FROM w.g AND " if scope else ""
    out = ", min(s.g) AS source" if scope else ""
    return f"""
WITH RECURSIVE s AS (
  SELECT row_number() OVER (ORDER BY {first}{order}) - 1 AS pos, {scope or 'NULL'} AS g, t, length(t) AS l
  FROM (SELECT doc_id, n_chars, {src} AS source, {sql_clean('text')} AS t FROM documents WHERE text IS NOT NULL)),
walk(pos, cur, bin, g) AS (
  SELECT pos, l + 1, CAST(0 AS BIGINT), g FROM s WHERE pos = 0
  UNION ALL
  SELECT s.pos,
         CASE WHEN {same}w.cur + s.l <= {PACK_T} THEN w.cur + s.l + 1 ELSE s.l + 1 END,
         CASE WHEN {same}w.cur + s.l <= {PACK_T} THEN w.bin ELSE w.bin + 1 END, s.g
  FROM walk w JOIN s ON s.pos = w.pos + 1)
SELECT w.bin AS bin_id{out}, count(*) AS n_docs, min(s.pos) AS first_pos,
       trim(string_agg(s.t, ' ' ORDER BY s.pos)) AS text
FROM walk w JOIN s ON s.pos = w.pos GROUP BY w.bin
"""


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", clean_text("text").alias("clinical_text"))


@register("g1", _pack_sql(None))
def q_g1(spark, sf_dir):
    """Global next-fit packing at 8,192 characters in doc_id order."""
    return pack_contexts(_docs(spark, sf_dir), PACK_T, order_cols=["doc_id"])


@register("g1_scoped", _pack_sql("source"))
def q_g1_scoped(spark, sf_dir):
    """Packing within each source (bins never span sources)."""
    return pack_contexts(_docs(spark, sf_dir), PACK_T, order_cols=["doc_id"], scope=["source"])


@register("g1_null_scope", _pack_sql("source", src="nullif(source, 'src3')"))
def q_g1_null_scope(spark, sf_dir):
    """Packing where one scope is null: a group like the others."""
    d = _docs(spark, sf_dir).withColumn("source", F.nullif("source", F.lit("src3")))
    return pack_contexts(d, PACK_T, order_cols=["doc_id"], scope=["source"])


@register("g1_ties", _pack_sql(None, order="floor(n_chars / 1000), doc_id"))
def q_g1_ties(spark, sf_dir):
    """Packing by a key with many ties, settled by doc_id."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.floor(F.col("n_chars") / 1000).alias("size"), clean_text("text").alias("clinical_text"))
    return pack_contexts(d, PACK_T, order_cols=["size", "doc_id"])


@register("g1_hashed_ids", _pack_sql(None, order="md5(CAST(doc_id AS VARCHAR))"))
def q_g1_hashed_ids(spark, sf_dir):
    """Packing in the order of hashed ids, far apart and not dense."""
    d = _docs(spark, sf_dir).withColumn("key", F.md5(F.col("doc_id").cast("string")))
    return pack_contexts(d, PACK_T, order_cols=["key"])


LINE_T = 120


@register("g1_blocks", f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, i, t, length(t) AS l, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, {sql_clean("unnest(ls)")} AS t FROM d)),
walk(doc_id, i, cur, bin) AS (
  SELECT doc_id, i, l + 1, 0 FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN w.cur + s.l <= {LINE_T} THEN w.cur + s.l + 1 ELSE s.l + 1 END,
         CASE WHEN w.cur + s.l <= {LINE_T} THEN w.bin ELSE w.bin + 1 END
  FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
b AS (SELECT s.*, dense_rank() OVER (ORDER BY doc_id, bin) - 1 AS bin FROM s JOIN walk USING (doc_id, i))
SELECT bin AS bin_id, min(doc_id) AS doc_id, count(*) AS n_docs, min(pos) AS first_pos,
       trim(string_agg(t, ' ' ORDER BY pos)) AS text FROM b GROUP BY bin
""")
def q_g1_blocks(spark, sf_dir):
    """Packing the lines of each document at 120 characters, in blocks of 128
    lines folded four at a time: over 50 blocks and several levels at any size."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    lines = lines.select("doc_id", "line", clean_text("text").alias("clinical_text"))
    return pack_contexts(lines, LINE_T, order_cols=["line"], scope=["doc_id"], block_rows=128, fan=4)


SQL_QUALITY = "(SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"


@register("j1", f"""
SELECT d.doc_id, q.doc_id IS NOT NULL AS is_quality
FROM documents d LEFT JOIN {SQL_QUALITY} q ON d.doc_id = q.doc_id
""")
def q_j1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    q = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return with_membership(d, q, "doc_id", "is_quality")


@register("g2", f"""
SELECT doc_id, unnest(range(0, CASE WHEN is_quality THEN 2 ELSE 1 END)) AS copy, n_chars
FROM (SELECT d.doc_id, d.n_chars, q.doc_id IS NOT NULL AS is_quality
      FROM documents d LEFT JOIN {SQL_QUALITY} q ON d.doc_id = q.doc_id)
""")
def q_g2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    q = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return upsample(d, q, 2.0).select("doc_id", "copy", "n_chars")
