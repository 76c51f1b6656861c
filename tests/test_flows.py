"""End-to-end flows on the smallest given tables."""

from pyspark.sql import functions as F

from quire.plans.embedding import embed_patients
from quire.plans.training import epoch_batches, prepare_training_data
from quire.session import scratch_path
from quire.sources import fixtures as fx

from conftest import SF_SMALL


def test_prepare_training_data(spark):
    paths = fx.render_all_sources(spark, SF_SMALL)
    out = prepare_training_data(spark, paths, scratch_path(spark, "flow"), max_length=32)
    corpus = spark.read.parquet(out["corpus"])
    tok = spark.read.parquet(out["tokenized"])
    vocab = spark.read.parquet(out["vocabulary"])
    assert corpus.count() == tok.count() + corpus.where(F.col("clinical_text").isNull()).count()
    assert vocab.count() % 64 == 0
    assert tok.where(F.size("input_ids") != 32).count() == 0
    total = spark.read.parquet(out["profile"]).where("level = 'all'").first()
    assert total.n_docs == corpus.count() and total.n_texts == tok.count()
    plan = {r.source: r for r in spark.read.parquet(out["plan"]).collect()}
    assert plan[None].total_samples == corpus.count()
    e = epoch_batches(tok, 1, vocab.count(), batch_size=16).collect()
    assert sorted(r.pos for r in e) == list(range(len(e)))
    assert any(any(l != -100 for l in r.labels) for r in e)


def test_embed_patients_prefix(spark):
    src = fx.render_patients(spark, SF_SMALL, scratch_path(spark, "pat"))
    out = embed_patients(spark, src, scratch_path(spark, "emb"), limit_rows=50)
    df = spark.read.parquet(out)
    assert df.count() == 50 and df.where(F.size("embedding") != 64).count() == 0


def test_cli_embed(spark, capsys):
    from quire.__main__ import main
    src = fx.render_patients(spark, SF_SMALL, scratch_path(spark, "cli-pat"))
    out = scratch_path(spark, "cli-emb")
    main(["embed", "--json", src, "--out", out, "--limit-rows", "5", "--shuffle-partitions", "8"])
    assert out in capsys.readouterr().out
    assert spark.read.parquet(out).count() == 5
