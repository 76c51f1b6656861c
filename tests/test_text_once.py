"""G1: a packed text is computed once; a null one is left out."""

from pyspark.sql import functions as F

from quire.operators.packing import pack_contexts


def test_a_costly_text_is_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        calls.add(1)
        return None if k % 4 == 0 else f" w{k} "

    docs = spark.range(40).select(F.col("id").alias("doc_id"), text("id").alias("clinical_text"))
    bins = pack_contexts(docs, 30, order_cols=["doc_id"]).orderBy("bin_id").collect()
    assert calls.value == 40
    assert [w for b in bins for w in b.text.split()] == [f"w{k}" for k in range(40) if k % 4]
    assert sum(b.n_docs for b in bins) == 30
