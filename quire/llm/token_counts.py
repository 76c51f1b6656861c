"""Token counts through a digest cache.

A text's key is the digest of its content as the tokenizer sees it together
with the tokenizer's version digest.  Counts already in the cache are joined;
only distinct missing contents are encoded, and their counts are appended, so
a later run over overlapping text encodes the difference alone.

* The content is normalised to what the tokenizer reads: null becomes the
  empty text; ``normalise`` may apply a tokenizer's own normaliser (none by
  default, since any other change would change counts).
* One text shuffle: ``groupBy(digest).agg(first(text))`` keeps one copy of a
  content per map task before the shuffle, so a group of copies that holds a
  third of all rows sends one row per task.
* The cache is Parquet, partitioned by tokenizer digest; appends are atomic
  under Spark's commit protocol and duplicate entries are harmless.

Edge cases: null and empty text have 0 bytes and 0 tokens; repeated rows and
repeated ids each get their own result row; an empty table gives an empty
result; other columns are passed through only when named in ``keep``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import bpe
from quire.session import ship_package

CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"


def with_digest(docs: DataFrame, keep: list[str], text: str, normalise=None) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    content = normalise(content) if normalise else content
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    return (docs.select(*kept, content.alias("content"))
            .withColumn("content_digest", F.unhex(F.sha2("content", 256))))


def cached_counts(spark, cache_path: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer, one row per content."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy(
        "tokenizer_digest").parquet(cache_path)
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
            .where(F.col("tokenizer_digest") == version)
            .groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens")))


def encode_counts(contents: DataFrame, tokenizer_json: str) -> DataFrame:
    """(content_digest, content) -> (content_digest, n_tokens)."""
    spark = contents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def count(batches):
        enc = bpe.encoder(shared.value)
        for b in batches:
            texts = b.column("content")
            n = [len(enc.ids(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("content_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return (contents.select("content_digest", "content")
            .mapInArrow(count, "content_digest binary, n_tokens long"))


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None,
                 keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                 normalise=None) -> DataFrame:
    """``keep`` columns plus ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's
    whole text, adding counts of contents not yet in ``cache_path``."""
    spark = docs.sparkSession
    tokenizer_json = bpe.read_json(tokenizer_path or bpe.default_path())
    version = bpe.digest(tokenizer_json)
    keyed = with_digest(docs, list(keep), text, normalise)
    known = cached_counts(spark, cache_path, version)
    distinct = keyed.groupBy("content_digest").agg(F.first("content").alias("content"))
    missing = distinct.join(known, "content_digest", "left_anti")
    (encode_counts(missing, tokenizer_json)
     .withColumn("tokenizer_digest", F.lit(version))
     .write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path))
    known = cached_counts(spark, cache_path, version)
    return (keyed.withColumn("n_bytes", F.octet_length("content").cast("long")).drop("content")
            .join(known, "content_digest", "left")
            .select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
                    "n_bytes", "n_tokens"))
