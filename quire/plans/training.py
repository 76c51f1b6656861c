"""Corpus -> training examples (the reference's training entry point, data
side): readers -> union -> positions -> vocabulary -> tokenise -> sink, plus
the training plan and per-epoch masked batches.

Everything is lazy until a write; each output is a Parquet table under
``out_dir``.  Model training itself is not part of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators.masking import mask_probability, mask_tokens
from quire.operators.ordering import epoch_order
from quire.operators.plan import training_plan
from quire.operators.tokens import build_vocabulary, pad_vocabulary, tokenize
from quire.plans.corpus import build_corpus
from quire.sources.sinks import write_corpus_profiled, write_tokenized


def prepare_training_data(spark: SparkSession, source_paths: dict[str, str], out_dir: str,
                          max_length: int = 128, vocab_size: int = 30522,
                          batch_size: int = 128, base_epochs: int = 50) -> dict[str, str]:
    """Write corpus, its profile, vocabulary, tokenised examples and the training plan.
    Returns the output paths."""
    out = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("corpus", "profile", "vocabulary", "tokenized", "plan")}
    corpus = build_corpus(spark, source_paths)
    write_corpus_profiled(corpus, out["corpus"]).coalesce(1).write.mode("overwrite").parquet(out["profile"])
    corpus = spark.read.parquet(out["corpus"])
    vocab = pad_vocabulary(build_vocabulary(corpus.where(F.col("clinical_text").isNotNull()),
                                            vocab_size=vocab_size))
    vocab.write.mode("overwrite").parquet(out["vocabulary"])
    docs = corpus.where(F.col("clinical_text").isNotNull())
    tok = tokenize(docs, spark.read.parquet(out["vocabulary"]), max_length, id_col="pos")
    write_tokenized(tok, out["tokenized"])
    # steps come from the examples there are: texts, not rows without one
    training_plan(docs, "source", batch_size=batch_size, base_epochs=base_epochs) \
        .write.mode("overwrite").parquet(out["plan"])
    return out


def epoch_batches(tokenized: DataFrame, epoch: int, vocab_size: int, seed: int = 42,
                  batch_size: int = 128, total_epochs: int = 50, id_col: str = "pos") -> DataFrame:
    """One epoch of masked examples: the epoch's shuffle order and batch ids
    (W6) with masking at the scheduled probability (M1, M2)."""
    ordered = epoch_order(tokenized.withColumnRenamed(id_col, "doc_id"), epoch, seed, "doc_id", batch_size)
    p = mask_probability(F.lit(epoch), total_epochs=total_epochs)
    return mask_tokens(ordered, p, epoch, seed=seed, vocab_size=vocab_size)
