"""From documents to packed training pieces: quality rules, near-duplicate
removal, benchmark decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``.  A row is named by
its id and the digest of its text, so null or repeated ids do no harm: repeated
rows are copies of one document, and of those one stays.  Texts without words
are rejected by the quality rules.  Other columns go along under names of their
own, whatever they are called.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.inverted_index import contamination
from quire.llm.jaccard_join import jaccard_classes
from quire.llm.packing import pack_tokens
from quire.llm.pii import pii_spans, redact
from quire.llm.quality import kept_documents
from quire.session import materialize

#: Expectation-maximisation, near-duplicate components and tokenising are not
#: SQL; the stages are tested against a brute-force version instead.
ORACLE_SQL = None


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _beside(stage):
    """The stage with all columns but ``COLUMNS`` renamed while it works, so that
    none can be taken for one of an operator's own."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = {c: c if c in COLUMNS else f"beside_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*safe.values()), sf_dir)
        return out.select(*[F.col(name).alias(c) for c, name in safe.items()])
    return run_stage


def _digest(docs: DataFrame):
    return F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))


def _named(docs: DataFrame) -> DataFrame:
    """The rows' names and texts, for operators that pass a key through."""
    return docs.select(F.struct(docs["doc_id"].alias("id"), _digest(docs).alias("digest")).alias("row"), "text")


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents that are (left_semi) or are not (left_anti) among named rows."""
    r = rows.select(F.col("row.id").alias("row_id"), F.col("row.digest").alias("row_digest")).distinct()
    return docs.join(r, docs["doc_id"].eqNullSafe(r["row_id"]) & (_digest(docs) == r["row_digest"]), how)


@_beside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their lines above the limit."""
    return kept_documents(docs)


@_beside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    classes = jaccard_classes(_named(docs), key="row")
    stay = classes.where(F.col("uid").isNull() | F.col("row").eqNullSafe(F.col("component_id")))
    kept = _among(docs, stay, "left_semi").withColumn("row_digest", _digest(docs))
    return kept.dropDuplicates(["doc_id", "row_digest"]).drop("row_digest")


@_beside
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    hit = contamination(_named(docs), benchmark, key="row").where("contaminated")
    return _among(docs, hit, "left_anti")


@_beside
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    names = [c for c in docs.columns if c != "doc_id"]
    found = pii_spans(docs, keep=tuple(names))
    text = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return (found.withColumn("text", text)
            .withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training pieces of the documents that are left."""
    return pack_tokens(docs.select(*COLUMNS), capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
