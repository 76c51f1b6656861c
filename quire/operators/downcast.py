"""A4: narrowest numeric type per column from one min/max pass.

Rules (strict inequalities, so a column reaching -128 or 127 stays wider):
integers go to tinyint, smallint or int when ``min > type_min and max <
type_max``; floating columns go to ``float`` when inside the half-precision
or single-precision range (Spark has no half type, so both land on float).
NaN is ignored by min/max (pandas skips it; Spark would order it last);
all-null, infinite or out-of-range columns are unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Numpy iinfo/finfo limits used by the rule.
INT_LIMITS = [("tinyint", -128, 127), ("smallint", -32768, 32767),
              ("int", -2147483648, 2147483647)]
FLOAT16_MAX = 65504.0
FLOAT32_MAX = 3.4028234663852886e38

_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT_TYPES = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[tuple[str, str]]:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _INT_TYPES):
            out.append((f.name, "int"))
        elif isinstance(f.dataType, _FLOAT_TYPES):
            out.append((f.name, "float"))
    return out


def _target(kind: str, mn, mx, before) -> F.Column:
    if kind == "int":
        expr = None
        for name, lo, hi in INT_LIMITS:
            cond = (mn > F.lit(lo)) & (mx < F.lit(hi))
            expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        return expr.otherwise(F.lit(before))
    cond16 = (mn > F.lit(-FLOAT16_MAX)) & (mx < F.lit(FLOAT16_MAX))
    cond32 = (mn > F.lit(-FLOAT32_MAX)) & (mx < F.lit(FLOAT32_MAX))
    return F.when(cond16 | cond32, F.lit("float")).otherwise(F.lit(before))


def downcast_plan(df: DataFrame) -> DataFrame:
    """One aggregate pass -> (column_name, type_before, min_value, max_value,
    type_after), one row per numeric column."""
    cols = numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns")
    aggs = []
    for name, kind in cols:
        c = F.col(name)
        v = F.when(~F.isnan(c), c) if kind == "float" else c
        aggs += [F.min(v).cast("double").alias(f"{name}__min"),
                 F.max(v).cast("double").alias(f"{name}__max")]
    row = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = []
    for name, kind in cols:
        mn, mx = F.col(f"{name}__min"), F.col(f"{name}__max")
        parts.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(types[name]).alias("type_before"),
            mn.alias("min_value"), mx.alias("max_value"),
            _target(kind, mn, mx, types[name]).alias("type_after")))
    return row.select(F.explode(F.array(*parts)).alias("d")).select("d.*")


def downcast(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Apply the plan.  The driver sees one row per numeric column only."""
    plan = {r["column_name"]: (r["type_before"], r["type_after"])
            for r in downcast_plan(df).collect()}
    changes = {c: after for c, (before, after) in plan.items() if after != before}
    out = df.select(*[F.col(c).cast(changes[c]).alias(c) if c in changes else F.col(c)
                      for c in df.columns])
    return out, changes
