"""Sinks: profile measured in the write (A1-A3), layout by position."""

import pytest
from pyspark.sql import functions as F

from quire.operators.ordering import with_positions
from quire.operators.profile import ObservedProfile, corpus_profile
from quire.session import scratch_path
from quire.sources.sinks import read_batches, read_positions, write_corpus_profiled, write_positions

CORPUS = "doc_id long, source string, clinical_text string"


def profile_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rows", [
    [(1, "discharge", "a b  c"), (2, "hcpcs", None), (3, "hcpcs", "é"), (4, "hcpcs", ""), (5, None, "x y")],
    [(1, "articles", None)],
])
def test_profile_of_the_write_equals_a_scan(spark, rows):
    df = spark.createDataFrame(rows, CORPUS).repartition(3)
    path = scratch_path(spark, "observed")
    got = write_corpus_profiled(df, path)
    assert profile_rows(got) == profile_rows(corpus_profile(df))
    assert spark.read.parquet(path).count() == len(rows)
    assert set(spark.read.parquet(path).columns) == {"doc_id", "source", "clinical_text"}


def test_profile_of_no_rows_is_a_total_of_nothing(spark):
    got = write_corpus_profiled(spark.createDataFrame([], CORPUS), scratch_path(spark, "observed"))
    assert [tuple(r) for r in got.collect()] == [("all", None, 0, 0, None, None, 0.0)]


def test_rows_of_an_unnamed_source_fail(spark):
    watch = ObservedProfile(["a"])
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], CORPUS)
    watch.watch(df).write.parquet(scratch_path(spark, "observed"))
    with pytest.raises(ValueError, match="1 rows of sources"):
        watch.result(spark)


def test_the_input_is_evaluated_once(spark):
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id doc_id", "'hcpcs' source", "'w w' clinical_text").mapInArrow(count, CORPUS)
    got = write_corpus_profiled(df, scratch_path(spark, "observed"))
    assert {r.n_docs for r in got.collect()} == {1000} and met.value == 1000


def files_read(df):
    """Files that the plan's scan opened (counted in a plan's first run only)."""
    df = df.select("*")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().get("numFiles").get().value()


def test_a_range_reads_its_folders_only(spark):
    numbered = with_positions(spark.range(1000).select(F.col("id").alias("k")).repartition(7), ["k"], n_partitions=5)
    path = write_positions(numbered, scratch_path(spark, "by-position"), chunk_rows=100)
    whole = read_positions(spark, path)
    assert whole.columns == ["k", "pos"] and whole.count() == 1000
    for first, stop in [(0, 1), (0, 250), (99, 101), (100, 200), (950, 5000), (0, 1000)]:
        part = read_positions(spark, path, first, stop)
        assert sorted(r.k for r in part.collect()) == list(range(first, min(stop, 1000)))
        folders = min(-(-stop // 100), 10) - first // 100
        assert folders <= files_read(part) <= folders + 5   # a folder may hold files of two tasks
    assert files_read(read_positions(spark, path, 0, 100)) < files_read(whole) / 3
    assert read_positions(spark, path, 5, 5).count() == 0
    assert read_positions(spark, path, 0, 0).count() == 0


def test_batches_come_from_the_layout(spark):
    numbered = spark.range(300).select(F.col("id").alias("n"), F.lit("x").alias("text"))
    path = write_positions(numbered, scratch_path(spark, "by-position"), 64, pos_col="n", in_order=False)
    got = read_batches(spark, path, 2, 5, batch_size=64).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in got} == {2: 64, 3: 64, 4: 44}


def test_layout_of_an_empty_table_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "pos long, text string")
    path = write_positions(empty, scratch_path(spark, "by-position"))
    assert read_positions(spark, path, 0, 10).collect() == [] and read_positions(spark, path).columns == ["pos", "text"]
    with pytest.raises(ValueError, match="taken"):
        write_positions(empty.withColumn("pos_chunk", F.lit(1)), path)
    with pytest.raises(ValueError, match="at least 1"):
        write_positions(empty, path, chunk_rows=0)
