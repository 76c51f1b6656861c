"""Language ID, toxicity, pseudo-likelihood: brute force and held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_CHECK, SF_SMALL
from quire.llm import langid, pseudo_likelihood as pl, queries as Q, toxicity
from quire.llm.wordhash import NON_SPACE, words

SF_BENCH = "/root/testdata/sf0.1"  # enough labels to hold some out

# ---- language ID ---------------------------------------------------------------


def slow_bits(train, text):
    """Code lengths by a plain dictionary context tree."""
    fold = lambda t: bytes(langid._fold[np.frombuffer(t.encode(), np.uint8)])
    out = {}
    for lang in sorted({x for _, x in train}):
        four = Counter(f[i:i + 4] for t, x in train if x == lang for f in [fold(t)] for i in range(len(f) - 3))
        counts = [Counter() for _ in range(4)]
        for g, n in four.items():
            for k in range(4):
                counts[k][g[3 - k:]] += n
        follow = [defaultdict(dict) for _ in range(4)]
        for k in range(4):
            for g, n in counts[k].items():
                follow[k][g[:-1]][g[-1]] = n

        def bits(context, byte):
            k = len(context)
            seen = follow[k].get(context)
            lower = (lambda: bits(context[1:], byte)) if k else (lambda: 8.0)
            if not seen:
                return lower()
            total = sum(seen.values()) + len(seen)
            return -math.log2(seen[byte] / total) if byte in seen else -math.log2(len(seen) / total) + lower()
        f = fold(text)
        out[lang] = sum(bits(f[max(0, i - 3):i], f[i]) for i in range(len(f)))
    return out


def test_code_lengths_equal_a_plain_context_tree(spark):
    train = [("the cat sat on the mat. The hat!", "en"), ("die katze saß auf der matte", "de"), ("the dog 42", "en"),
             ("le chat était là", "fr")]
    model = langid.train(spark.createDataFrame(train, "text string, lang string").repartition(3))
    code = langid.CodeLengths(model)
    texts = ["the katze", "", "a", "là", "zzzz\x00\x00 QX 7 日本", "the cat sat on the mat. The hat!"]
    data, offsets = langid.text_buffer(pa.array(texts))
    got = code.texts(data, offsets)
    for t, row in zip(texts, got, strict=True):
        want = slow_bits(train, t)
        assert np.allclose(row, [want[x] for x in code.languages])


def test_language_accuracy_and_edges(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = Q.op8(spark, SF_CHECK).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == len(docs)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    odd = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "12 .. !", "z"), (None, "the", "z"), (None, "the", "z")],
                                "doc_id long, text string, score string")
    model = langid.train(spark.createDataFrame([("the the", "en"), ("der der", "de"), (None, "fr"), ("x", None)],
                                               "text string, lang string"))
    assert sorted(model) == ["de", "en"]
    assert sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(odd, model).collect()) == [
        ("1", "und"), ("2", "und"), ("3", "und"), ("None", "en"), ("None", "en")]
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


# ---- toxicity -------------------------------------------------------------------


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_BENCH}/labels.parquet").collect()}
    got = Q.op9(spark, SF_BENCH).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    clean = [r.predicted for r in held if not labels[r.doc_id]]
    assert np.mean(clean) < 0.02 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def mentions(n):
    """Insults beside one group's name only, so the name looks toxic."""
    rows = []
    for i in range(n):
        rows.append((4 * i, f"what an idiot this muslim w{i % 7} is", 1))
        rows.append((4 * i + 1, f"the christian w{i % 7} is here today", 0))
        rows.append((4 * i + 2, f"idiot and moron w{i % 5}", 1))
        rows.append((4 * i + 3, f"nothing w{i % 5} to report. fine", 0))
    return rows


def test_swaps_lower_false_positives(spark):
    rows = mentions(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "a muslim came"), (2, "a christian came"), (3, "idiot"), (4, None), (5, "")],
                                  "doc_id long, text string")
    gap, insult = {}, {}
    for c in (0.0, 5.0):
        model = toxicity.train(labels, docs=docs, counterfactual=c)
        s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
        gap[c], insult[c] = s[1] - s[2], s[3]
        assert s[4] == s[5]
    assert gap[5.0] < 0.05 < gap[0.0] and insult[5.0] > 0.5


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 6), (3, "idiot " * 9, 7)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(none, docs=docs)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.train(none, docs=docs)).count() == 0


# ---- pseudo-likelihood ----------------------------------------------------------


def test_scores_equal_word_by_word_sums(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    texts = docs.select("text")
    vocab = pl.vocabulary(texts)
    counts = pl.context_counts(texts, spark.sparkContext.broadcast(vocab))
    rows = docs.collect()
    rx, seen = re.compile("[^\x20\x09-\x0D]+"), Counter()
    for r in rows:
        w = rx.findall(r.text or "")
        cls = [int(vocab.classify(words(pa.array([x]), NON_SPACE)[0])[0][0]) for x in w]
        seen.update(zip([pl._EDGE] + cls[:-1], cls[1:] + [pl._EDGE], cls) if w else ())
    assert {k: int(counts[k]) for k in zip(*np.nonzero(counts))} == dict(seen)
    net = pl.WindowNetwork()
    losses = net.train(counts, rounds=60)
    table = net.log_probabilities()
    assert losses[-1] < losses[0] and np.allclose(np.exp(table).sum(-1), 1)
    # one context by the formula
    p = net.p
    h = np.tanh(p["L"][3] + p["R"][5] + p["b"])
    z = h @ p["U"] + p["c"]
    assert np.allclose(table[3, 5], z - np.log(np.exp(z).sum()))


def test_scores_prefer_the_corpus_order_and_edges(spark):
    import random
    rng = random.Random(3)
    base = "the cat sat on a mat and then it ran to its bed".split()
    rows = [(i, " ".join(base * rng.randrange(2, 6))) for i in range(200)]
    shuffled = base * 4
    rng.shuffle(shuffled)
    rows += [(900, " ".join(base * 4)), (901, " ".join(shuffled)), (902, None), (903, " \n"), (None, "cat"), (None, "cat")]
    docs = spark.createDataFrame([r + (1,) for r in rows], "doc_id long, text string, n_tokens int")
    got = pl.pseudo_likelihood(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[900].log_prob > by[901].log_prob + 20
    assert (by[902].n_tokens, by[902].log_prob, by[902].mean_log_prob) == (0, 0.0, None) and by[903].n_tokens == 0
    assert pl.pseudo_likelihood(docs.limit(0)).count() == 0
    assert abs(by[900].mean_log_prob * by[900].n_tokens - by[900].log_prob) < 1e-6


def test_every_counted_word_has_its_own_share(spark):
    many = [f"w{i}" for i in range(pl.WORDS + 500)]
    rows = [(i, " ".join(many[j:j + 400])) for i, j in enumerate(list(range(0, len(many), 400)) * 6)]
    rows += [(10_000 + i, "w1 w2 often w3 w4") for i in range(5)] + [(20_000, "w1 w2 once w3 w4")]
    got = {r.doc_id: r.log_prob for r in pl.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10_000] > got[20_000] + 0.5
    sizes = [pl.class_count(n) for n in (10, 10**5, 10**6, 10**8)]
    assert sizes[0] == pl.CLASSES and sizes == sorted(set(sizes))


def test_second_neighbours_count(spark):
    import random
    rng, pairs = random.Random(5), [("red", "apple"), ("blue", "berry"), ("green", "leaf")]
    rows = [(i, " ".join(f"{a} of {b} and then" for a, b in rng.choices(pairs, k=12))) for i in range(300)]
    rows += [(900, "so red of apple and then"), (901, "so red of berry and then")]
    got = {r.doc_id: r.log_prob for r in pl.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] > got[901] + 1
