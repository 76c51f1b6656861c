"""Positions without a single-partition window."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.ordering import (assign_batches, epoch_order, epoch_positions, prefix_series, take_prefix,
                                      number_in_input_order, with_positions)
from quire.operators.fold import block_states


def test_positions_match_sorted_order_for_any_partitioning(spark):
    random.seed(3)
    rows = [(random.randint(0, 5), random.randint(0, 10**9), i) for i in range(2000)]
    rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
    expected = {(a, b): i for i, (a, b, _) in enumerate(sorted(rows))}
    for parts, buckets in [(1, 1), (4, 3), (17, 17), (5, 100)]:   # 100: binary-search path
        df = spark.createDataFrame(rows, "g int, k long, v long").repartition(parts)
        got = {(r.g, r.k): r.pos for r in with_positions(df, ["g", "k"], n_partitions=buckets).collect()}
        assert got == expected


def test_positions_string_keys_and_materialize(spark):
    words = ["b", "a", "é", "Z", "aa", "", "zz", "ab"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in with_positions(df, ["w"], n_partitions=3).orderBy("pos").collect()]
    assert got == sorted(words, key=lambda s: s.encode("utf-8"))


def test_positions_empty(spark):
    df = spark.createDataFrame([], "k long")
    assert with_positions(df, ["k"]).count() == 0


def test_prefix_batches_and_series(spark):
    df = with_positions(spark.range(0, 1050).withColumn("v", F.lit(2)), ["id"])
    assert take_prefix(df, 100).count() == 100
    b = assign_batches(df, 64).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [64] * 16 + [26]
    s = prefix_series(df, 500, ["v"]).orderBy("prefix_size").collect()
    assert [(r.prefix_size, r.n_rows, r.sum_v) for r in s] == [(500, 500, 1000), (1000, 1000, 2000), (1500, 1050, 2100)]


def test_epoch_order_is_a_permutation_and_epoch_dependent(spark):
    d = spark.range(0, 300).withColumnRenamed("id", "doc_id")
    e0 = {r.doc_id: r.pos for r in epoch_order(d, 0, batch_size=32).collect()}
    e1 = {r.doc_id: r.pos for r in epoch_order(d, 1, batch_size=32).collect()}
    assert sorted(e0.values()) == list(range(300)) and sorted(e1.values()) == list(range(300))
    assert e0 != e1
    again = {r.doc_id: r.pos for r in epoch_order(d.repartition(7), 0, batch_size=32).collect()}
    assert again == e0


def test_positions_null_keys_first(spark):
    rows = [(None, 5), (1, None), (1, 2), (0, 9), (None, None), (2, 1), (0, None), (3, 3)]
    df = spark.createDataFrame(rows, "a long, b long")
    exp = [(r.a, r.b) for r in df.orderBy(F.asc_nulls_first("a"), F.asc_nulls_first("b")).collect()]
    for n in (1, 2, 4):
        got = [(r.a, r.b) for r in with_positions(df, ["a", "b"], n_partitions=n).orderBy("pos").collect()]
        assert got == exp


def test_positions_of_equal_keys_and_a_dominant_source(spark):
    df = spark.range(0, 40000).select(
        F.when(F.col("id") % 10 < 6, 0).otherwise(F.col("id") % 10).alias("rank"), F.col("id").alias("doc_id"))
    by_rank = with_positions(df, ["rank"], n_partitions=16)
    assert by_rank.select("pos").distinct().count() == 40000
    assert by_rank.agg(F.min("pos"), F.max("pos")).first() == (0, 39999)
    both = with_positions(df, ["rank", "doc_id"], n_partitions=16)
    assert both.where("rank = 0").agg(F.max("pos")).first()[0] == 23999


def counted_rows(spark, n, columns="id"):
    """A Python source of n rows and the count of rows it has produced."""
    made = spark.sparkContext.accumulator(0)

    def produce(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.range(0, n, 1, 4).mapInArrow(produce, "id long"), made


def test_an_input_is_evaluated_once(spark):
    df, made = counted_rows(spark, 1000)
    got = with_positions(df.withColumn("k", -F.col("id")), ["k"])
    assert [r.id for r in got.orderBy("pos").collect()] == list(range(999, -1, -1))
    assert got.agg(F.sum("pos")).first()[0] == 999 * 500
    assert made.value == 1000
    df, made = counted_rows(spark, 1000)
    df = df.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    got = number_in_input_order(df, ["part"], "row")
    assert [r.id for r in got.orderBy("pos").collect()] == list(range(1000))
    assert got.count() == 1000 and made.value == 1000


def test_equal_keys_are_spread_over_ranges(spark):
    df = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    got = with_positions(df, ["k"], n_partitions=16)
    files = sorted(set(got.inputFiles()))
    rows = [spark.read.parquet(f).count() for f in files]
    assert len(rows) >= 15 and max(rows) < 10_000
    assert got.select("pos").distinct().count() == 100_000


def test_input_order_moves_no_rows_and_refuses_gaps(spark):
    df = spark.range(0, 500, 1, 5).select("id", (4 - F.spark_partition_id()).alias("split"), F.lit("x").alias("text"),
                                              F.monotonically_increasing_id().alias("row"))
    got = number_in_input_order(df, ["split"], "row")
    assert [r.id // 100 for r in got.orderBy("pos").collect()] == [4] * 100 + [3] * 100 + [2] * 100 + [1] * 100 + [0] * 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    torn = df.withColumn("split", F.col("id") % 2)
    with pytest.raises(Exception, match="gaps"):
        number_in_input_order(torn, ["split"], "row").count()
    assert number_in_input_order(df.where("id < 0"), ["split"], "row").count() == 0


def test_fold_gives_every_block_its_state_at_any_fan(spark):
    # maps x -> a * x + b modulo a prime, which do not commute
    p = 10_007
    maps = [((i * 37 + 5) % p, (i * 91 + 1) % p) for i in range(150)]
    df = spark.createDataFrame([(i, list(m)) for i, m in enumerate(maps)], "block long, map array<long>").repartition(5)
    expected, x = [], 12
    for a, b in maps:
        expected.append(x)
        x = (a * x + b) % p
    for fan in (7, 1024):
        got = block_states(df, 150, [12], lambda f, g: [f[0] * g[0] % p, (g[0] * f[1] + g[1]) % p],
                           lambda f, s: [(f[0] * s[0] + f[1]) % p], fan=fan)
        assert [r.state[0] for r in got.orderBy("block").collect()] == expected
    assert block_states(df.where("block < 0"), 0, [1], max, max).count() == 0


def test_keyed_permutation_of_any_size_without_a_shuffle(spark):
    for n in (1, 2, 3, 7, 97, 500, 1025):
        df = spark.range(0, n, 1, 3).withColumnRenamed("id", "pos")
        seen = []
        for epoch in (0, 1):
            got = epoch_positions(df, n, epoch, batch_size=10)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            seen.append([(r.shuffled, r.batch_id) for r in got.orderBy("pos").collect()])
            assert sorted(s for s, _ in seen[-1]) == list(range(n)) and all(b == s // 10 for s, b in seen[-1])
        assert n < 90 or (seen[0] != seen[1] and seen[0] != sorted(seen[0]))
    with pytest.raises(Exception, match="outside"):
        epoch_positions(spark.range(5).withColumnRenamed("id", "pos"), 4, 0).collect()
    big = 10**15 + 37   # whole division: no digits lost
    got = epoch_positions(spark.range(big - 50, big).withColumnRenamed("id", "pos"), big, 0).collect()
    assert len({r.shuffled for r in got}) == 50 and all(0 <= r.shuffled < big for r in got)
