"""Incremental ingest of note CSVs and article XML.

Each trigger picks up only new files, in bounded micro-batches
(``maxFilesPerTrigger``, default 1000 files); ``trigger(availableNow=True)``
processes everything present, then stops.

*Notes.*  The stream carries file names; a micro-batch is read by the batch
reader (splits, headers and row identity are the same) and written to its own
folder of the sink, overwritten if the batch is run again: exactly-once output,
so a restart adds no duplicates.  A file without a header or a text column does
not stop the stream; it is set aside with its error (``note_stream_errors``).

*Articles.*  The batch reader's transformations run unchanged on a text stream
into an exactly-once Parquet sink.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.sources.articles import END_TAG, corpus_columns, records_of
from quire.sources.notes import read_notes
from quire.sources.xml_parse import parse_records

DEFAULT_FILES_PER_TRIGGER = 1000
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
NOTE_SCHEMA = "doc_id long, source string, clinical_text string"
ERROR_SCHEMA = "file string, error string"


def file_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = DEFAULT_FILES_PER_TRIGGER) -> DataFrame:
    """New files of a folder, by name; their content is not read."""
    r = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(src_dir).select("path")


def _no_glob(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def articles_stream(spark: SparkSession, src_dir: str,
                    max_files_per_trigger: int | None = DEFAULT_FILES_PER_TRIGGER) -> DataFrame:
    r = spark.readStream.option("lineSep", END_TAG)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.text(src_dir)
    parsed = parse_records(records_of(raw))
    rows = parsed.select(*corpus_columns(), F.lit("articles").alias("source"), "error", "xml")
    return (rows.where((F.col("clinical_text") != "") | F.col("error").isNotNull())
            .select("doc_id", "source", "clinical_text", "error", "xml"))


def run_to_parquet(stream: DataFrame, sink_dir: str, checkpoint_dir: str) -> None:
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def ingest_notes_stream(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint_dir: str, label: str, clean: bool = True,
                        max_files_per_trigger: int | None = DEFAULT_FILES_PER_TRIGGER) -> DataFrame:
    """Corpus rows ingested so far."""
    def take(batch: DataFrame, batch_id: int) -> None:
        paths = [_no_glob(r.path) for r in batch.collect()]  # at most max_files_per_trigger names
        if paths:
            rows = read_notes(batch.sparkSession, paths, label, clean, refused=f"{sink_dir}/_refused/batch={batch_id}")
            rows.select("doc_id", "source", "clinical_text").write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    q = (file_stream(spark, src_dir, max_files_per_trigger).writeStream.foreachBatch(take)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    for schema, at in ((NOTE_SCHEMA, "batch=none"), (ERROR_SCHEMA, "_refused/batch=none")):  # both can be read, also when empty
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{sink_dir}/{at}")
    return spark.read.schema(NOTE_SCHEMA).option("recursiveFileLookup", True).parquet(sink_dir)


def note_stream_errors(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(file, error) of the note files a stream has set aside."""
    return spark.read.schema(ERROR_SCHEMA).option("recursiveFileLookup", True).parquet(f"{sink_dir}/_refused")


def ingest_articles_stream(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint_dir: str,
                           **kw) -> DataFrame:
    """Corpus rows ingested so far.  A malformed record does not stop the
    stream: it lands in the same exactly-once sink with its error
    (``article_stream_errors``)."""
    run_to_parquet(articles_stream(spark, src_dir, **kw), sink_dir, checkpoint_dir)
    return spark.read.parquet(sink_dir).where(F.col("error").isNull()).select("doc_id", "source", "clinical_text")


def article_stream_errors(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(xml, error) of the malformed records a stream has met."""
    return spark.read.parquet(sink_dir).where(F.col("error").isNotNull()).select("xml", "error")
