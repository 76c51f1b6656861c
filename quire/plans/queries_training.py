"""Queries for measurement and training preparation (A4, A5, M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.downcast import FLOAT16_MAX, FLOAT32_MAX, INT_LIMITS, downcast, downcast_plan
from quire.operators.masking import mask_probability
from quire.operators.plan import training_plan
from quire.plans.registry import register
from quire.sources.fixtures import table

LINEITEM_NUMERIC = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                    ("l_linenumber", "int"), ("l_quantity", "double"),
                    ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double")]


def _sql_target(kind: str, before: str) -> str:
    if kind == "int":
        whens = " ".join(f"WHEN min_value > {lo} AND max_value < {hi} THEN '{n}'"
                         for n, lo, hi in INT_LIMITS)
        return f"CASE {whens} ELSE '{before}' END"
    return (f"CASE WHEN (min_value > {-FLOAT16_MAX!r} AND max_value < {FLOAT16_MAX!r}) OR "
            f"(min_value > {-FLOAT32_MAX!r} AND max_value < {FLOAT32_MAX!r}) THEN 'float' ELSE '{before}' END")


def _sql_a4() -> str:
    parts = []
    for c, t in LINEITEM_NUMERIC:
        kind = "float" if t in ("double", "float") else "int"
        v = f"CASE WHEN NOT isnan({c}) THEN {c} END" if kind == "float" else c
        inner = (f"SELECT '{c}' AS column_name, '{t}' AS type_before, "
                 f"CAST(min({v}) AS DOUBLE) AS min_value, CAST(max({v}) AS DOUBLE) AS max_value FROM lineitem")
        parts.append(f"SELECT column_name, type_before, min_value, max_value, "
                     f"{_sql_target(kind, t)} AS type_after FROM ({inner})")
    return " UNION ALL ".join(parts)


@register("a4", _sql_a4())
def q_a4(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*[c for c, _ in LINEITEM_NUMERIC])
    return downcast_plan(li)


@register("a4_applied", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST({c} AS FLOAT) AS {c}" if t in ("double", "float") else f"CAST({c} AS BIGINT) AS {c}"
    for c, t in LINEITEM_NUMERIC if c not in ("l_orderkey", "l_linenumber")) + " FROM lineitem")
def q_a4_applied(spark, sf_dir):
    """A4's cast carried out: integers read back as long, to compare values."""
    li = table(spark, sf_dir, "lineitem").select(*[c for c, _ in LINEITEM_NUMERIC])
    out, changes = downcast(li)
    assert changes and dict(out.dtypes) != dict(li.dtypes)
    return out.select(*[F.col(c).cast("float" if t in ("double", "float") else "long" if c not in (
        "l_orderkey", "l_linenumber") else t).alias(c) for c, t in LINEITEM_NUMERIC])


SQL_EPOCHS = ("CAST(CASE WHEN n < 10000 THEN 100 WHEN n < 100000 THEN 50 "
              "WHEN n < 1000000 THEN 25 ELSE 12 END AS BIGINT)")
SQL_PLAN = f"""
SELECT level, source, n AS total_samples, n * 512 AS total_tokens, CAST(128 AS BIGINT) AS batch_size,
       epochs, spe AS steps_per_epoch, spe * epochs AS total_steps,
       greatest(CAST(trunc(0.1::DOUBLE * (spe * epochs)) AS BIGINT), 100) AS warmup_steps,
       (n * epochs) // 128 AS num_training_steps,
       CAST(trunc(0.1::DOUBLE * ((n * epochs) // 128)) AS BIGINT) AS num_warmup_steps
FROM (SELECT level, source, n, {SQL_EPOCHS} AS epochs, (n + 127) // 128 AS spe
      FROM (SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS level, source, count(*) AS n
            FROM documents GROUP BY ROLLUP (source)))
"""


@register("a5", SQL_PLAN)
def q_a5(spark, sf_dir):
    return training_plan(table(spark, sf_dir, "documents").select("source"), "source")


@register("m1", f"""
SELECT e AS epoch,
       greatest(least(0.30::DOUBLE - (0.30::DOUBLE - 0.15::DOUBLE) * (e::DOUBLE / 49.0::DOUBLE), 1.0), 0.0)
         AS mlm_probability
FROM (SELECT unnest(range(0, epochs)) AS e
      FROM (SELECT {SQL_EPOCHS} AS epochs FROM (SELECT count(*) AS n FROM documents)))
""")
def q_m1(spark, sf_dir):
    plan = training_plan(table(spark, sf_dir, "documents").select("source"), None)
    ep = plan.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    return ep.select("epoch", mask_probability(F.col("epoch")).alias("mlm_probability"))


@register("w6", """
SELECT doc_id, epoch, pos, CAST(floor(pos / 128) AS BIGINT) AS batch_id FROM (
  SELECT doc_id, 3 AS epoch,
         row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', 42, 3, doc_id)), 1, 8))::BIGINT, doc_id) - 1
           AS pos
  FROM documents)
""")
def q_w6(spark, sf_dir):
    """Epoch-3 shuffle (hash of seed:epoch:doc_id) and batches of 128."""
    from quire.operators.ordering import epoch_order
    d = table(spark, sf_dir, "documents").select("doc_id")
    return epoch_order(d, epoch=3, seed=42, batch_size=128, method="md5").select(
        "doc_id", "epoch", "pos", "batch_id")


@register("w6_permuted", """
WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM documents, n),
w(doc_id, n, a, b, x, walk) AS (
  SELECT doc_id, n, a, b, pos, 0 FROM s
  UNION ALL
  SELECT doc_id, n, a, b, list_reduce(list_prepend(x, range(8)), lambda x, k: CASE WHEN k % 2 = 0
      THEN ((x // b + ('0x' || substr(md5(concat_ws(':', 42, 3, k, x % b)), 1, 8))::BIGINT % a) % a) * b + x % b
      ELSE (x // b) * b + (x % b + ('0x' || substr(md5(concat_ws(':', 42, 3, k, x // b)), 1, 8))::BIGINT % b) % b END), walk + 1
  FROM w WHERE walk = 0 OR x >= n)
SELECT doc_id, 3 AS epoch, x AS pos, x // 128 AS batch_id FROM w WHERE walk > 0 AND x < n
""")
def q_w6_permuted(spark, sf_dir):
    """W6 by a keyed permutation of the rows' numbers."""
    from quire.operators.ordering import epoch_positions, with_positions
    d = with_positions(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return epoch_positions(d, d.count(), epoch=3, seed=42, batch_size=128, method="md5").select(
        "doc_id", "epoch", F.col("shuffled").alias("pos"), "batch_id")


@register("lr_schedule", f"""
SELECT step, round(CASE WHEN step < w THEN step::DOUBLE / greatest(1.0, w::DOUBLE)
            ELSE greatest(0.0, 0.5 * (1.0 + cos(pi() * ((step::DOUBLE - w::DOUBLE)
                                                       / greatest(1.0, n::DOUBLE - w::DOUBLE))))) END, 9)
         AS lr_multiplier
FROM (SELECT num_training_steps AS n, num_warmup_steps AS w, unnest(range(0, num_training_steps)) AS step
      FROM ({SQL_PLAN}) WHERE level = 'all')
""")
def q_lr_schedule(spark, sf_dir):
    """Cosine schedule with warm-up over the whole corpus' training steps."""
    from quire.operators.plan import lr_schedule
    plan = training_plan(table(spark, sf_dir, "documents").select("source"), None)
    return lr_schedule(plan).select("step", F.round("lr_multiplier", 9).alias("lr_multiplier"))
