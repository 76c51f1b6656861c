"""Render the reference's input formats from the given Parquet tables.

Every renderer is a Spark job writing under the session's checkpoint folder,
so round-trip queries (write a format, read it back with the operator) grow
with the tables.  Rules (FIXTURES.md §3):

* notes CSV (gz): ``note_id = doc_id``, constant metadata, all cells quoted,
  quotes doubled; English and German documents are discharge notes, all others
  (no language included) radiology notes;
* article XML: first text line -> ``ArticleTitle``, every later line -> one
  ``AbstractText``; ``& < >`` escaped;
* code tables: ``ICD {version} code for {code}: {description}``;
* patients: one visit per order of a customer, and one without an order for
  customers that have none, as JSON lines or as ``{patient_id: {field: text}}``
  objects.

Notes, articles and codes are written in key order over ascending files, so
input order (file, row) is key order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import code_text
from quire.session import ensure_parallelism, scratch_path

# Languages of discharge notes (all else is radiology),
# code-table versions per source.
DISCHARGE_LANGS = ["en", "de"]
NOTE_SOURCES = ["discharge", "radiology"]
CODE_TABLES = {"diagnosis": ("part", "9", "p_partkey", "p_name"),
               "procedure": ("nation", "10", "n_nationkey", "n_name"),
               "hcpcs": ("region", "11", "r_regionkey", "r_name")}
DISPOSITIONS = {"F": "Admitted", "O": "ADMITTED to ward", "P": "Discharged home"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; scans that come out as fewer partitions than the
    cluster's parallelism (one large row group) are spread first."""
    return ensure_parallelism(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def notes_of(documents: DataFrame, source: str) -> DataFrame:
    """The documents that are notes of a source; every document is in one."""
    discharge = F.coalesce(F.col("lang").isin(DISCHARGE_LANGS), F.lit(False))
    return documents.where(discharge if source == "discharge" else ~discharge)


def notes_frame(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("note_id"),
        F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("subject_id"),
        F.lit("H0").alias("hadm_id"), F.lit("DS").alias("note_type"),
        F.lit("1").alias("note_seq"), F.lit("2180-01-01 00:00:00").alias("charttime"),
        F.lit("2180-01-01 00:00:00").alias("storetime"), F.col("text"))


def in_order(df: DataFrame, key: str, n_files: int | None = None) -> DataFrame:
    """Rows by key over ascending output files."""
    ranged = df.repartitionByRange(n_files, key) if n_files else df.repartitionByRange(key)
    return ranged.sortWithinPartitions(key)


def render_notes(documents: DataFrame, path: str, source: str | None = None, n_files: int | None = None) -> str:
    """Notes of one source (all documents if None)."""
    d = documents if source is None else notes_of(documents, source)
    (notes_frame(in_order(d, "doc_id", n_files)).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("compression", "gzip").csv(path))
    return path


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def article_records(documents: DataFrame) -> DataFrame:
    lines = F.split(F.col("text"), "\n", -1)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    abstract = F.when(F.size(rest) > 0, F.concat(
        F.lit("<Abstract>"),
        F.array_join(F.transform(rest, lambda x: F.concat(
            F.lit("<AbstractText>"), _esc(x), F.lit("</AbstractText>"))), ""),
        F.lit("</Abstract>"))).otherwise(F.lit(""))
    rec = F.concat(
        F.lit('<PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="1">'),
        F.col("doc_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>"),
        _esc(F.get(lines, 0)), F.lit("</ArticleTitle>"), abstract,
        F.lit("</Article></MedlineCitation></PubmedArticle>"))
    return documents.select(rec.alias("value"))


def render_articles(documents: DataFrame, path: str, n_files: int | None = None) -> str:
    article_records(in_order(documents, "doc_id", n_files)).write.mode("overwrite").text(path)
    return path


def code_frame(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    name, version, key, desc = CODE_TABLES[source]
    t = in_order(table(spark, sf_dir, name), key)
    return t.select(F.lit(version).alias("version"), F.col(key).cast("string").alias("code"),
                    F.col(desc).alias("description"),
                    code_text(F.lit(version), F.col(key), F.col(desc)).alias("text"))


def render_code_table(spark: SparkSession, sf_dir: str, source: str, path: str) -> str:
    (code_frame(spark, sf_dir, source).write.mode("overwrite").option("header", True)
     .option("quoteAll", True).option("escape", '"').csv(path))
    return path


def patient_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit (order, or customer without one) with ten text fields
    (nulls by key rule)."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct(
        "o_orderkey", "o_orderstatus", "o_orderpriority").alias("o"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    k = F.col("c_custkey")
    gap7 = (k % 7) == 0
    gap11 = (k % 11) == 0

    def unless(cond, v):
        return F.when(~cond, v)

    disp = F.col("o.o_orderstatus")
    disp_text = None
    for code, text in DISPOSITIONS.items():
        disp_text = (F.when(disp == code, F.lit(text)) if disp_text is None
                     else disp_text.when(disp == code, F.lit(text)))
    return j.select(
        F.concat_ws("-", k.cast("string"), F.col("o.o_orderkey").cast("string")).alias("patient_id"),
        unless(gap11, F.concat(F.lit("Patient "), F.col("c_name"), F.lit(" arrived by walk-in. "))).alias("arrival"),
        F.concat(F.lit("Triage segment "), F.col("c_mktsegment"), F.lit(". ")).alias("triage"),
        unless(gap7, F.concat(F.lit("Codes N"), F.col("c_nationkey").cast("string"), F.lit(". "))).alias("codes"),
        unless(gap7, F.concat(F.lit("Vitals recorded for "), F.col("c_name"), F.lit(". "))).alias("vitals"),
        unless(gap7, F.concat(F.lit("Dispensed order "), F.col("o.o_orderkey").cast("string"), F.lit(". "))).alias("pyxis"),
        unless(gap7, F.concat(F.lit("Medication priority "), F.col("o.o_orderpriority"), F.lit(". "))).alias("medrecon"),
        disp_text.alias("eddischarge"),
        F.concat(F.lit("Admission "), k.cast("string")).alias("admission"),
        F.concat(F.lit("Discharge "), k.cast("string")).alias("discharge"),
        disp.alias("eddischarge_category"))


def _one_object(batches):
    """A partition's pairs as one object, a line at a time."""
    lead = "{"
    for b in batches:
        lines = []
        for pair in b.column("pair").to_pylist():
            lines.append(lead + pair)
            lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["{}" if lead == "{" else "}"], pa.string())], ["value"])


def render_patients(spark: SparkSession, sf_dir: str, path: str, layout: str = "lines") -> str:
    """``lines``: one JSON object a line; ``object``: files that are one
    ``{patient_id: {field: text}}`` object each."""
    p = patient_frame(spark, sf_dir)
    if layout == "lines":
        p.write.mode("overwrite").json(path)
        return path
    entry = F.concat(F.to_json(F.struct("patient_id")), F.lit("|"), F.to_json(F.struct(*p.columns[1:]), {"ignoreNullFields": "false"}))
    pair = F.concat(F.regexp_extract(entry, r'^\{"patient_id":(".*?")\}\|', 1), F.lit(":"), F.regexp_extract(entry, r"\|(.*)$", 1))
    p.select(pair.alias("pair")).mapInArrow(_one_object, "value string").write.mode("overwrite").text(path)
    return path


def render_all_sources(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Render the six corpus sources; returns source -> path."""
    docs = table(spark, sf_dir, "documents")
    out = {}
    for src in NOTE_SOURCES:
        out[src] = render_notes(docs, scratch_path(spark, f"notes-{src}"), src)
    out["articles"] = render_articles(docs, scratch_path(spark, "articles"))
    for src in CODE_TABLES:
        out[src] = render_code_table(spark, sf_dir, src, scratch_path(spark, f"codes-{src}"))
    return out
