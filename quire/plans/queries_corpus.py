"""Queries over the corpus sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import NA_TOKENS
from quire.operators.ordering import assign_batches, prefix_series, with_positions
from quire.operators.patients import (admitted_label, assemble_info, fill_defaults,
                                      patient_documents)
from quire.plans.corpus import build_corpus, read_source
from quire.plans.registry import register, sql_clean, sql_words
from quire.session import scratch_path
from quire.sources import fixtures as fx
from quire.sources.articles import parsed_records, read_articles_quarantined
from quire.sources.notes import read_notes
from quire.sources.patients import read_patients
from quire.sources.sinks import (read_batches, read_corpus, read_positions, write_corpus, write_corpus_profiled,
                                 write_positions)

_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


SQL_DISCHARGE = "coalesce(lang IN (" + ", ".join(f"'{x}'" for x in fx.DISCHARGE_LANGS) + "), FALSE)"


def sql_note(source: str, rank: int | None, clean: bool = True) -> str:
    body = sql_clean("text") if clean else "text"
    r = f", {rank} AS source_rank" if rank is not None else ""
    which = SQL_DISCHARGE if source == "discharge" else f"NOT {SQL_DISCHARGE}"
    return (f"SELECT doc_id, '{source}' AS source{r}, "
            f"CASE WHEN text IN ({_NA}) THEN NULL ELSE {body} END AS clinical_text "
            f"FROM documents WHERE {which}")


SQL_ARTICLE_PARTS = r"""
SELECT doc_id,
       regexp_replace(ls[1], '^\s+|\s+$', '', 'g') AS title,
       CASE WHEN len(ls) > 1 THEN array_to_string(list_transform(
            list_filter(ls[2:], lambda x: x <> ''),
            lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' ') END AS abstract
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
"""


def sql_articles(rank: int | None) -> str:
    r = f", {rank} AS source_rank" if rank is not None else ""
    return f"""
SELECT doc_id, 'articles' AS source{r}, clinical_text FROM (
  SELECT doc_id, CASE WHEN title <> '' AND abstract <> '' THEN title || ' ' || abstract
                      WHEN title <> '' THEN title WHEN abstract <> '' THEN abstract END AS clinical_text
  FROM ({SQL_ARTICLE_PARTS})) WHERE clinical_text <> ''"""


def sql_code(source: str, rank: int | None) -> str:
    name, version, key, desc = fx.CODE_TABLES[source]
    r = f", {rank} AS source_rank" if rank is not None else ""
    return (f"SELECT CAST({key} AS BIGINT) AS doc_id, '{source}' AS source{r}, "
            f"'ICD {version} code for ' || {key} || ': ' || {desc} AS clinical_text FROM {name}")


SQL_CORPUS = ("SELECT doc_id, source, source_rank, row_number() OVER (ORDER BY source_rank, doc_id) - 1 AS pos, "
              "clinical_text FROM (" + " UNION ALL ".join([
                  sql_note("discharge", 0), sql_note("radiology", 1), sql_articles(2),
                  sql_code("diagnosis", 3), sql_code("procedure", 4), sql_code("hcpcs", 5)]) + ")")


# ---- S1 / P1 / P2: notes ---------------------------------------------------

def _notes(spark, sf_dir, clean=True):
    docs = fx.table(spark, sf_dir, "documents")
    frames = []
    for src in fx.NOTE_SOURCES:
        path = fx.render_notes(docs, scratch_path(spark, f"notes-{src}"), src)
        frames.append(read_notes(spark, path, src, clean=clean)
                      .select("doc_id", "source", "clinical_text"))
    return frames[0].unionByName(frames[1])


@register("s1", sql_note("discharge", None) + " UNION ALL " + sql_note("radiology", None))
def q_s1(spark, sf_dir):
    return _notes(spark, sf_dir)


@register("p1", sql_note("discharge", None, clean=False) + " UNION ALL "
          + sql_note("radiology", None, clean=False))
def q_p1(spark, sf_dir):
    """P1 (metadata dropped when present) and P2 raw copy (no cleaning)."""
    return _notes(spark, sf_dir, clean=False)


# ---- S2 / T2-T4 / P5: articles ---------------------------------------------

def _article_parts(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    path = fx.render_articles(docs, scratch_path(spark, "articles"))
    return parsed_records(spark, path)


@register("s2", sql_articles(None))
def q_s2(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    path = fx.render_articles(docs, scratch_path(spark, "articles"))
    return read_source(spark, "articles", path).select("doc_id", "source", "clinical_text")


@register("t2", f"SELECT doc_id, nullif(title, '') AS title FROM ({SQL_ARTICLE_PARTS})")
def q_t2(spark, sf_dir):
    p = _article_parts(spark, sf_dir)
    return p.select(F.expr("try_cast(pmid AS BIGINT)").alias("doc_id"),
                    F.nullif("title", F.lit("")).alias("title"))


@register("t3", f"SELECT doc_id, coalesce(abstract, '') AS abstract FROM ({SQL_ARTICLE_PARTS})")
def q_t3(spark, sf_dir):
    p = _article_parts(spark, sf_dir)
    return p.select(F.expr("try_cast(pmid AS BIGINT)").alias("doc_id"), "abstract")


# ---- S3 / T5: code tables --------------------------------------------------

@register("s3", " UNION ALL ".join(sql_code(s, None) for s in fx.CODE_TABLES))
def q_s3(spark, sf_dir):
    frames = [read_source(spark, s, fx.render_code_table(spark, sf_dir, s, scratch_path(spark, f"codes-{s}")))
              for s in fx.CODE_TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("doc_id", "source", "clinical_text")


@register("t5", " UNION ALL ".join(
    f"SELECT '{v}' AS version, CAST({k} AS VARCHAR) AS code, "
    f"'ICD {v} code for ' || {k} || ': ' || {d} AS text FROM {n}"
    for n, v, k, d in fx.CODE_TABLES.values()))
def q_t5(spark, sf_dir):
    out = None
    for s in fx.CODE_TABLES:
        f = fx.code_frame(spark, sf_dir, s).select("version", "code", "text")
        out = f if out is None else out.unionByName(f)
    return out


# ---- U1 / W1 / S6: the corpus ------------------------------------------------

@register("u1", SQL_CORPUS)
def q_u1(spark, sf_dir):
    return build_corpus(spark, fx.render_all_sources(spark, sf_dir))


@register("s6", f"SELECT source, count(*) AS n_rows, CAST(sum(length(clinical_text)) AS BIGINT) AS n_chars, "
          f"min(pos) AS min_pos, max(pos) AS max_pos FROM ({SQL_CORPUS}) GROUP BY source")
def q_s6(spark, sf_dir):
    """Corpus written partitioned by source, read back, summarised."""
    path = write_corpus(build_corpus(spark, fx.render_all_sources(spark, sf_dir)),
                        scratch_path(spark, "corpus"))
    c = read_corpus(spark, path)
    return c.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("clinical_text")).cast("long").alias("n_chars"),
        F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"))


@register("w1", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents")
def q_w1(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return with_positions(d, ["n_chars", "doc_id"]).select("doc_id", "pos")


SQL_DOC_POS = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, n_chars FROM documents"


@register("w2", f"""
SELECT prefix_size, n_rows, sum_n_chars FROM (
  SELECT CAST((k + 1) * 500 AS BIGINT) AS prefix_size,
         CAST(sum(r) OVER (ORDER BY k) AS BIGINT) AS n_rows,
         CAST(sum(c) OVER (ORDER BY k) AS BIGINT) AS sum_n_chars
  FROM (SELECT CAST(floor(pos / 500) AS BIGINT) AS k, count(*) AS r, sum(n_chars) AS c
        FROM ({SQL_DOC_POS}) GROUP BY 1)) WHERE n_rows = prefix_size
""")
def q_w2(spark, sf_dir):
    """Prefix series (W2): every full prefix of 500, 1000, ... rows."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    p = with_positions(d, ["doc_id"])
    s = prefix_series(p, 500, ["n_chars"])
    return s.where(F.col("n_rows") == F.col("prefix_size")).select(
        "prefix_size", "n_rows", F.col("sum_n_chars").cast("long").alias("sum_n_chars"))


@register("w3", f"""
SELECT CAST(floor(pos / 64) AS BIGINT) AS batch_id, count(*) AS n_rows,
       min(pos) AS first_pos, max(n_chars) AS max_chars
FROM ({SQL_DOC_POS}) GROUP BY 1
""")
def q_w3(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    b = assign_batches(with_positions(d, ["doc_id"]), 64)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"),
                                     F.max("n_chars").alias("max_chars"))


def _laid_out(spark, sf_dir):
    """Documents numbered by doc_id in a sink of about 64 folders, and how many there are."""
    p = with_positions(fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"])
    n = p.count()
    return write_positions(p, scratch_path(spark, "by-position"), max(1, n // 64)), n


@register("w2_chunks", f"SELECT pos, doc_id, n_chars FROM ({SQL_DOC_POS}) "
          "WHERE pos < (SELECT count(*) // 2 FROM documents)")
def q_w2_chunks(spark, sf_dir):
    """The first half of the documents, from the folders that hold it."""
    path, n = _laid_out(spark, sf_dir)
    return read_positions(spark, path, 0, n // 2).select("pos", "doc_id", "n_chars")


@register("w3_chunks", f"""
SELECT CAST(floor(pos / 64) AS BIGINT) AS batch_id, count(*) AS n_rows, min(pos) AS first_pos, max(n_chars) AS max_chars
FROM ({SQL_DOC_POS}) WHERE pos >= (SELECT count(*) // 128 FROM documents) * 64 GROUP BY 1
""")
def q_w3_chunks(spark, sf_dir):
    """Batches of the second half, from the folders that hold them."""
    path, n = _laid_out(spark, sf_dir)
    b = read_batches(spark, path, n // 128, -(-n // 64))
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"),
                                     F.max("n_chars").alias("max_chars"))


@register("a1_observed", f"""
SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'source' END AS level, source, count(*) AS n_docs,
       count(clinical_text) AS n_texts, avg({sql_words('clinical_text')}) AS avg_words,
       CAST(sum(length(clinical_text)) AS BIGINT) AS n_chars,
       coalesce(sum(octet_length(encode(clinical_text))), 0) / 1048576.0 AS size_mb
FROM ({SQL_CORPUS}) GROUP BY ROLLUP (source)
""")
def q_a1_observed(spark, sf_dir):
    """Profile of the six-source corpus (A1-A3), measured while it is written."""
    corpus = build_corpus(spark, fx.render_all_sources(spark, sf_dir))
    return write_corpus_profiled(corpus, scratch_path(spark, "corpus"))


# ---- S4 / P6-P10 / E4: patients -------------------------------------------------

SQL_PATIENTS = """
SELECT concat_ws('-', c_custkey, o_orderkey) AS patient_id,
  CASE WHEN c_custkey % 11 <> 0 THEN 'Patient ' || c_name || ' arrived by walk-in. ' END AS arrival,
  'Triage segment ' || c_mktsegment || '. ' AS triage,
  CASE WHEN c_custkey % 7 <> 0 THEN 'Codes N' || c_nationkey || '. ' END AS codes,
  CASE WHEN c_custkey % 7 <> 0 THEN 'Vitals recorded for ' || c_name || '. ' END AS vitals,
  CASE WHEN c_custkey % 7 <> 0 THEN 'Dispensed order ' || o_orderkey || '. ' END AS pyxis,
  CASE WHEN c_custkey % 7 <> 0 THEN 'Medication priority ' || o_orderpriority || '. ' END AS medrecon,
  CASE o_orderstatus WHEN 'F' THEN 'Admitted' WHEN 'O' THEN 'ADMITTED to ward'
                     WHEN 'P' THEN 'Discharged home' END AS eddischarge,
  'Admission ' || c_custkey AS admission,
  'Discharge ' || c_custkey AS discharge,
  o_orderstatus AS eddischarge_category
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
"""
SQL_FILLED = f"""
SELECT patient_id, arrival, triage,
  coalesce(codes, 'The patient received no diagnostic codes') AS codes,
  coalesce(vitals, 'The patient had no vitals recorded') AS vitals,
  coalesce(pyxis, 'The patient did not receive any medications.') AS pyxis,
  coalesce(medrecon, 'The patient was previously not taking any medications.') AS medrecon,
  CASE WHEN contains(lower(eddischarge), 'admitted') THEN 1 ELSE 0 END AS eddischarge
FROM ({SQL_PATIENTS})
"""


def _patients(spark, sf_dir):
    path = fx.render_patients(spark, sf_dir, scratch_path(spark, "patients"))
    return read_patients(spark, path, layout="lines")


@register("s4", SQL_PATIENTS)
def q_s4(spark, sf_dir):
    return _patients(spark, sf_dir)


@register("p6", f"SELECT patient_id, codes, vitals, pyxis, medrecon FROM ({SQL_FILLED})")
def q_p6(spark, sf_dir):
    return fill_defaults(_patients(spark, sf_dir)).select("patient_id", "codes", "vitals", "pyxis", "medrecon")


@register("p7", f"SELECT patient_id, eddischarge FROM ({SQL_FILLED})")
def q_p7(spark, sf_dir):
    p = _patients(spark, sf_dir)
    return p.select("patient_id", admitted_label("eddischarge").alias("eddischarge"))


@register("p9", f"SELECT patient_id, arrival || codes || triage || vitals || pyxis || medrecon AS info "
          f"FROM ({SQL_PATIENTS})")
def q_p9(spark, sf_dir):
    """P9 without defaults: null whenever any part is null."""
    return assemble_info(_patients(spark, sf_dir)).select("patient_id", "info")


@register("e4", f"SELECT patient_id, arrival || codes || triage || vitals || pyxis || medrecon AS info, "
          f"eddischarge FROM ({SQL_FILLED})")
def q_e4(spark, sf_dir):
    return patient_documents(_patients(spark, sf_dir))


@register("a3", """
SELECT source, coalesce(sum(octet_length(encode(t))), 0) / 1048576.0 AS size_mb
FROM (SELECT source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) GROUP BY ROLLUP (source)
""")
def q_a3(spark, sf_dir):
    """A3: corpus size in MB (UTF-8 bytes) per source and overall."""
    from quire.operators.profile import corpus_profile
    from quire.plans.registry import documents_corpus
    return corpus_profile(documents_corpus(spark, sf_dir)).select("source", "size_mb")


@register("t4", sql_articles(None).replace("'articles' AS source, ", ""))
def q_t4(spark, sf_dir):
    """T4: title/abstract combination (non-empty records only, P5)."""
    from quire.functions.text import combine_title_abstract
    p = _article_parts(spark, sf_dir)
    return (p.select(F.expr("try_cast(pmid AS BIGINT)").alias("doc_id"),
                     combine_title_abstract("title", "abstract").alias("clinical_text"))
            .where(F.col("clinical_text") != ""))


@register("s5", f"SELECT doc_id, {SQL_DISCHARGE} AS from_discharge FROM documents")
def q_s5(spark, sf_dir):
    """Files discovered by a glob over two rendered note folders; the reader
    keeps each row's file."""
    docs = fx.table(spark, sf_dir, "documents")
    root = scratch_path(spark, "notes-glob")
    for src in fx.NOTE_SOURCES:
        fx.render_notes(docs, f"{root}/{src}", src)
    rows = read_notes(spark, f"{root}/*/part-*.csv.gz", "notes")
    return rows.select("doc_id", F.col("file").contains("/discharge/").alias("from_discharge"))


# ---- files of mixed headers, keys, quarantine, the object layout -------------

@register("s1_headers", f"""
SELECT CASE WHEN doc_id % 3 = 2 THEN NULL ELSE doc_id END AS doc_id, doc_id % 3 AS layout,
       CASE WHEN text IN ({_NA}) THEN NULL ELSE {sql_clean('text')} END AS clinical_text FROM documents
""")
def q_s1_headers(spark, sf_dir):
    """S1 over three layouts in one folder: the usual header, columns in another
    order with an extra one, and no id column."""
    docs = fx.table(spark, sf_dir, "documents")
    root = scratch_path(spark, "notes-headers")
    n = fx.notes_frame(docs).withColumn("layout", F.col("note_id").cast("long") % 3)
    shapes = [["note_id", "subject_id", "text"], ["extra", "text", "subject_id", "note_id"], ["text", "subject_id"]]
    for k, columns in enumerate(shapes):
        (n.where(F.col("layout") == k).withColumn("extra", F.lit("S9")).select(columns).write.option("header", True)
         .option("quoteAll", True).option("escape", '"').option("compression", "gzip").csv(f"{root}/layout{k}"))
    rows = read_notes(spark, f"{root}/*/part-*.csv.gz", "notes")
    layout = F.regexp_extract("file", "layout([0-9])/", 1).cast("long")
    return rows.select(F.when(layout != 2, F.col("doc_id")).alias("doc_id"), layout.alias("layout"), "clinical_text")


@register("s3_keys", """
SELECT v || ':' || z || p_partkey AS code_key, p_name AS clinical_text, count(*) OVER () AS n_keys
FROM part, (VALUES ('9'), ('10')) AS a(v), (VALUES (''), ('0')) AS b(z)
""")
def q_s3_keys(spark, sf_dir):
    """S3 with leading zeros and two versions: every code keeps its own key."""
    p = fx.table(spark, sf_dir, "part")
    path = scratch_path(spark, "codes-keys")
    rows = p.select(F.explode(F.array(F.lit("9"), F.lit("10"))).alias("version"), "p_partkey", "p_name").select(
        "version", F.explode(F.array(F.lit(""), F.lit("0"))).alias("z"), "p_partkey", "p_name")
    (rows.select("version", F.concat("z", F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("text"))
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    got = read_source(spark, "diagnosis", path)
    n = got.agg(F.countDistinct("code_key").alias("n_keys"))
    return got.select("code_key", "clinical_text").join(n)


@register("s2_quarantine", f"""
SELECT doc_id, FALSE AS is_error, clinical_text FROM ({sql_articles(None)}) WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, TRUE, NULL FROM documents WHERE doc_id % 10 = 0
""")
def q_s2_quarantine(spark, sf_dir):
    """S2 with every tenth record malformed: good rows and an error table."""
    docs = fx.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "articles-broken")
    broken = F.when(F.regexp_extract("value", "<PMID[^>]*>([0-9]+)<", 1).cast("long") % 10 == 0,
                    F.regexp_replace("value", "</ArticleTitle>", "")).otherwise(F.col("value"))
    fx.article_records(docs).select(broken.alias("value")).write.text(path)
    good, errors = read_articles_quarantined(spark, path)
    return good.select("doc_id", F.lit(False).alias("is_error"), "clinical_text").unionByName(errors.select(
        F.regexp_extract("xml", "<PMID[^>]*>([0-9]+)<", 1).cast("long").alias("doc_id"), F.lit(True).alias("is_error"),
        F.lit(None).cast("string").alias("clinical_text")))


@register("s4_object", SQL_PATIENTS)
def q_s4_object(spark, sf_dir):
    """S4 in the layout of one JSON object per file."""
    path = fx.render_patients(spark, sf_dir, scratch_path(spark, "patients-object"), layout="object")
    return read_patients(spark, path, layout="object")
