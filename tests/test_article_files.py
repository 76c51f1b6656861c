"""Rendered articles: files follow the range partitions, in key order."""

from quire.session import scratch_path
from quire.sources import fixtures as fx


def test_articles_are_not_written_by_a_fixed_few_tasks(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('title ', id, '\\nbody') AS text").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = fx.render_articles(docs, scratch_path(spark, "t-articles"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.text(path).selectExpr("_metadata.file_path AS file", "CAST(regexp_extract(value, 'PMID[^>]*>([0-9]+)', 1) AS long) AS k").collect()
    files = sorted({r.file for r in rows})
    assert len(files) > 3
    keys = [[r.k for r in rows if r.file == f] for f in files]
    assert [k for part in keys for k in sorted(part)] == list(range(200))
    assert all(part == sorted(part) for part in keys)
