"""Article XML (``PubmedArticle`` records), T2-T4.

Files are split into records by the closing tag (``lineSep``), which keeps a
record whole even when a file is split across tasks and keeps memory at one
record.  Element text follows the element-``.text`` convention: only the text
*before the first child node* counts, so ``T <i>x</i> tail`` yields ``T``.
That is the XPath step ``text()[not(preceding-sibling::node())]``.

Two parsers: the default reads each record's events once in Arrow batches
(``xml_parse``); ``parser="xpath"`` stays in the JVM with Spark's ``xpath``
(three DOM parses per record; text after a CDATA boundary is cut there,
``ab<![CDATA[cd]]>ef`` gives ``ab``).  A malformed record fails the job in
``read_articles``; ``read_articles_quarantined`` returns the good rows and a
table of the malformed records with their errors, so none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import clean_text, combine_title_abstract, py_strip
from quire.session import materialize
from quire.sources.csv_rows import canonical_number
from quire.sources.xml_parse import parse_records

END_TAG = "</PubmedArticle>"
_START = r"(?s)(<PubmedArticle[\s>].*)$"
TITLE_PATH = "(//ArticleTitle)[1]/text()[not(preceding-sibling::node())]"
ABSTRACT_PATH = "//Abstract/AbstractText/text()[not(preceding-sibling::node())]"
PMID_PATH = "(//PMID)[1]/text()[not(preceding-sibling::node())]"


def records_of(raw: DataFrame) -> DataFrame:
    """``xml``, ``file`` and ``block`` (where its split begins in the file) of
    the records in a text scan split at the closing tag."""
    rec = F.regexp_extract("value", _START, 1)
    # null (not '') when a chunk holds no record: filters above may be
    # evaluated after common xpath subexpressions, and xpath(null) is null
    xml = F.when(rec != "", F.concat(rec, F.lit(END_TAG)))
    return raw.select(xml.alias("xml"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block")).where(F.col("xml").isNotNull())


def _records(spark: SparkSession, path) -> DataFrame:
    return records_of(spark.read.option("lineSep", END_TAG).text(path))


def parse_article_records(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """One row per record: pmid, title (T2), abstract (T3), all stripped."""
    x = F.col(xml_col)
    pmid = py_strip(F.get(F.xpath(x, F.lit(PMID_PATH)), 0))
    title = py_strip(F.get(F.xpath(x, F.lit(TITLE_PATH)), 0))
    parts = F.xpath(x, F.lit(ABSTRACT_PATH))
    abstract = F.array_join(F.transform(parts, lambda p: py_strip(p)), " ")
    return df.select(pmid.alias("pmid"), title.alias("title"), abstract.alias("abstract"), "file", "block",
                     F.monotonically_increasing_id().alias("row"))


def parsed_records(spark: SparkSession, path, parser: str = "python") -> DataFrame:
    """(pmid, title, abstract) per record; a malformed one fails the job."""
    recs = _records(spark, path)
    if parser == "xpath":
        return parse_article_records(recs)
    return strict(parse_records(recs))


def strict(parsed: DataFrame) -> DataFrame:
    """The parsed fields; a malformed record raises (from whichever field is
    used, so a filter on the text cannot drop the record first)."""
    fail = F.raise_error(F.concat(F.lit("malformed article record: "), "error")).cast("string")
    checked = [F.when(F.col("error").isNotNull(), fail).otherwise(F.col(c)).alias(c) for c in ("pmid", "title", "abstract")]
    return parsed.select(*checked, "file", "block", "row")


def corpus_columns(clean: bool = False) -> list:
    """doc_id and clinical_text of parsed records."""
    text = combine_title_abstract("title", "abstract")
    return [article_key().alias("doc_id"), (clean_text(text) if clean else text).alias("clinical_text")]


def article_key():
    """A PMID in canonical decimal form keeps its value; any other, or a
    missing one, is hashed with the record's fields."""
    return F.coalesce(canonical_number("pmid"), F.xxhash64(F.col("pmid"), F.col("title"), F.col("abstract")))


def to_corpus_rows(parsed: DataFrame, clean: bool = False) -> DataFrame:
    """P5: records with non-empty text (null and '' dropped, ' ' kept)."""
    out = parsed.select(*corpus_columns(clean), "file", "block", "row")
    return out.where(F.col("clinical_text") != "").withColumn("source", F.lit("articles"))


def read_articles(spark: SparkSession, path, clean: bool = False, parser: str = "python") -> DataFrame:
    """S2.  ``parser="python"`` (default, Arrow batches, one parse per
    record) or ``"xpath"`` (JVM only, three DOM parses per record)."""
    return to_corpus_rows(parsed_records(spark, path, parser), clean)


def read_articles_quarantined(spark: SparkSession, path, clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """(corpus rows, errors): malformed records come back as (xml, error)
    rows.  The parse is written once and read by both."""
    parsed = materialize(parse_records(_records(spark, path)), "articles-parsed")
    good = parsed.where(F.col("error").isNull())
    return to_corpus_rows(good, clean), parsed.where(F.col("error").isNotNull()).select("xml", "error")
