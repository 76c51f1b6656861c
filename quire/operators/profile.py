"""Corpus measurements (A1, A2, A3): counts, mean words, size.

One aggregate with a ROLLUP over the grouping column yields the per-source
rows and the overall row (grouping column null, ``level`` = 'all') in a single
scan with partial (map-side) aggregation.  ``ObservedProfile`` takes the same
measures of the fixed sources while their corpus is being written: no second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from quire.functions.text import word_count

MB = 1048576.0


def corpus_profile(df: DataFrame, text_col: str = "clinical_text",
                   group_col: str | None = "source") -> DataFrame:
    t = F.col(text_col)
    # per-row measures first: ROLLUP expands every row once per grouping
    # set, and the text functions must run once per row, not per set
    keep = [group_col] if group_col else []
    rows = df.select(*keep, t.isNotNull().cast("int").alias("__has"),
                     word_count(t).alias("__w"), F.length(t).cast("long").alias("__c"),
                     F.octet_length(t).cast("long").alias("__b"))
    aggs = [
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("__has").cast("long").alias("n_texts"),
        F.avg("__w").alias("avg_words"),
        F.sum("__c").cast("long").alias("n_chars"),
        (F.coalesce(F.sum("__b"), F.lit(0)) / F.lit(MB)).alias("size_mb"),
    ]
    if group_col is None:
        return rows.agg(*aggs)
    out = rows.rollup(group_col).agg(F.grouping(group_col).alias("_g"), *aggs)
    return out.select(
        level(F.col("_g")), group_col, "n_docs", "n_texts", "avg_words", "n_chars", "size_mb")


class ObservedProfile:
    """``corpus_profile`` of rows on their way into a sink, without a scan of its own.

    ``watch(df)`` is ``df`` with the measures attached; write it, then ask for
    ``result``.  Measures are sums per source, so ``sources`` names all there are (a
    null source counts as one more; rows of any other fail ``result``).  Only the
    watched frame's last stage may follow: Spark counts each task of a writing stage
    once, however often it was tried, but tasks before a shuffle once per run.
    Sources without rows are left out, the total never is: over no rows it has
    counts of 0 and a null mean."""

    _SUMS = {"docs": "__one", "texts": "__has", "words": "__w", "chars": "__c", "bytes": "__b"}

    def __init__(self, sources: list[str], text_col: str = "clinical_text", group_col: str = "source"):
        self.groups, self.text_col, self.group_col = [*sources, None], text_col, group_col
        self.seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        t, of = F.col(self.text_col), F.col(self.group_col)
        measured = df.select("*", F.lit(1).alias("__one"), t.isNotNull().cast("int").alias("__has"),
                             word_count(t).cast("long").alias("__w"), F.length(t).cast("long").alias("__c"),
                             F.octet_length(t).cast("long").alias("__b"))
        sums = [F.coalesce(F.sum(F.when(of.eqNullSafe(F.lit(g)), F.col(c))), F.lit(0)).cast("long").alias(f"{name}_{i}")
                for i, g in enumerate(self.groups) for name, c in self._SUMS.items()]
        return measured.observe(self.seen, F.count(F.lit(1)).alias("rows"), *sums).drop(*self._SUMS.values())

    def result(self, spark: SparkSession) -> DataFrame:
        """The measures, as ``corpus_profile`` gives them.  Waits for the write."""
        got = self.seen.get
        rows = [("source", g, *[got[f"{name}_{i}"] for name in self._SUMS]) for i, g in enumerate(self.groups)]
        if sum(r[2] for r in rows) != got["rows"]:
            raise ValueError(f"{got['rows'] - sum(r[2] for r in rows)} rows of sources that are not among {self.groups[:-1]}")
        rows.append(("all", None, *[sum(r[k] for r in rows) for k in range(2, 7)]))
        table = spark.createDataFrame(rows, "level string, source string, docs long, texts long, words long, chars long, bytes long")
        has = F.col("texts") > 0
        return table.where("docs > 0 or level = 'all'").select(
            "level", F.col("source").alias(self.group_col), F.col("docs").alias("n_docs"), F.col("texts").alias("n_texts"),
            F.when(has, F.col("words") / F.col("texts")).alias("avg_words"),
            F.when(has, F.col("chars")).alias("n_chars"), (F.col("bytes") / F.lit(MB)).alias("size_mb"))


def row_counts(df: DataFrame, group_col: str = "source") -> DataFrame:
    """A1 alone: rows per group (``level`` 'source') plus the total ('all'), so
    that a null group and the total stay apart."""
    out = df.rollup(group_col).agg(F.grouping(group_col).alias("_g"), F.count(F.lit(1)).alias("n_rows"))
    return out.select(level(F.col("_g")), group_col, "n_rows")


def level(grouping):
    return F.when(grouping == 1, F.lit("all")).otherwise(F.lit("source")).alias("level")
