"""Query registry: (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL.

Every query reads the given tables (or files Spark renders from them) in
full.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.functions.text import clean_text, word_count
from quire.operators.profile import corpus_profile, row_counts
from quire.session import ship_package
from quire.sources.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run
    return deco


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a cleaned corpus keyed by doc_id, grouped by source."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", clean_text("text").alias("clinical_text"))


# DuckDB equivalents of T1 / T6 (ASCII \s is enough for the given text).
SQL_CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
SQL_WORDS = "CAST(len(regexp_extract_all({c}, '\\S+')) AS BIGINT)"


def sql_clean(c: str) -> str:
    return SQL_CLEAN.format(c=c)


def sql_words(c: str) -> str:
    return SQL_WORDS.format(c=c)


# ---- step 1: T1, T6, A1-A3 ------------------------------------------------

@register("t1", f"""
SELECT doc_id, {sql_clean('text')} AS clinical_text FROM documents
""")
def q_t1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", clean_text("text").alias("clinical_text"))


@register("t6", f"""
SELECT doc_id, {sql_words('text')} AS n_words FROM documents
""")
def q_t6(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", word_count("text").alias("n_words"))


@register("a1", """
SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS level, source, count(*) AS n_rows
FROM documents GROUP BY ROLLUP (source)
""")
def q_a1(spark, sf_dir):
    return row_counts(table(spark, sf_dir, "documents"), "source")


PROFILE_SQL = f"""
WITH c AS (SELECT source, {sql_clean('text')} AS t FROM documents)
SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS level,
       source,
       count(*) AS n_docs,
       count(t) AS n_texts,
       avg({sql_words('t')}) AS avg_words,
       CAST(sum(length(t)) AS BIGINT) AS n_chars,
       coalesce(sum(octet_length(encode(t))), 0) / 1048576.0 AS size_mb
FROM c GROUP BY ROLLUP (source)
"""


@register("a2", PROFILE_SQL)
def q_a2(spark, sf_dir):
    return corpus_profile(documents_corpus(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


def _load_all():
    # further query modules register themselves on import
    import quire.plans.queries_corpus  # noqa: F401
    import quire.plans.queries_training  # noqa: F401
    import quire.plans.queries_mix  # noqa: F401
    import quire.plans.queries_tokens  # noqa: F401
    import quire.plans.queries_eval  # noqa: F401
    import quire.plans.queries_infer  # noqa: F401
