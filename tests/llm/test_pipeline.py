"""The pipeline against the stages' brute-force versions."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm import bpe
from quire.llm.pii import pii_spans
from test_jaccard import brute as near
from test_pii import base
from test_quality import brute as rules
from test_tokens_index import brute as leaks

TEXT = "some long enough text of more than twenty words that is here to be read by every one of the rules in order number "


def rows_of(path_rows):
    filler = lambda i: " ".join(f"x{chr(97 + i % 26)}{chr(97 + j % 26)}{j // 26}" for j in range(40))
    extra = [(9001, TEXT + filler(1) + " mail a.b@c.de now", "en", "s"), (9002, TEXT + filler(2), None, None),
             (9003, None, None, "s"), (9004, "", "en", "s"), (None, TEXT + filler(3), "en", "s"),
             (9005, TEXT + filler(4), "en", "s"), (9005, TEXT + filler(4), "en", "s"), (9006, TEXT + filler(4), "de", "t")]
    return [tuple(r) for r in path_rows] + extra


def test_run_equals_brute_force(spark, tmpdir_path):
    from conftest import SF_SMALL
    given = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = rows_of(given)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmpdir_path}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    items.write.parquet(f"{tmpdir_path}/benchmark.parquet")

    verdict = {}
    for i, (d, t, _, s) in enumerate(rows):
        verdict[i] = (i, t, s)
    kept = {r[0] for r in rules(list(verdict.values())) if r[7]}
    left = [i for i in range(len(rows)) if i in kept]
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)
    order = {i: n for n, i in enumerate(sorted(left, key=key))}
    back = {n: i for i, n in order.items()}
    groups = near([(order[i], rows[i][1]) for i in left])
    left = [i for i in left if back[groups[order[i]][1]] == i]
    hit = {r[0] for r in leaks([(i, rows[i][1]) for i in left], [(r.item_id, r.text) for r in items.collect()]) if r[5]}
    left = [i for i in left if i not in hit]
    clean = {}
    numbered = spark.createDataFrame([(i, rows[i][1]) for i in left], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in pii_spans(numbered).collect()}
    for i in left:
        t, at, out = rows[i][1], 0, ""
        assert set(base(t)) <= set(spans[i])
        for a, b, k in spans[i]:
            if a >= at:
                out += t[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        clean[rows[i][0]] = out + t[at:]

    got = P.run(spark, tmpdir_path).collect()
    tokens, held = Counter(), bpe.encoder(bpe.read_json(bpe.default_path()))
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(held.ids(t)) + 1 for i, t in clean.items()}
    assert 0 < len(clean) < len(rows)


def test_stages_keep_the_columns(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF_SMALL)
        assert empty.columns == docs.columns and empty.count() == 0
    assert len(P.STAGES) == 5


def test_columns_of_any_name_go_along(spark):
    from conftest import SF_SMALL
    names = ["row_digest", "v_kept", "v_host", "v_removed", "base", "spans", "key", "row", "uid", "component_id", "digest", "kept",
             "candidates", "beside_0", "keep_text", "contaminated", "items", "with space", "a.b"]
    given = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    docs = given.select("*", *[F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows, name
        assert all(r[len(P.COLUMNS) + i] == f"{n} of {r.doc_id}" for r in rows for i, n in enumerate(names))
    assert P.STAGES[-1][1](spark, docs, SF_SMALL).count() > 0
