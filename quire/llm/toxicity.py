"""Toxicity by a counterfactual-regularised logistic classifier.

The classifier sees which words a text holds.  Words are chosen by how
unevenly toxic and clean labelled texts hold them; identity terms are always
among them.  In labelled sentences that name an identity term, the term is
swapped for another of its group, and training adds a penalty on the squared
change of the score.  So what decides is the insult, not the group that is
mentioned, and neutral mentions are not flagged.

Training uses at most ``SAMPLE`` labelled texts of each class, chosen by hash
of their key over all labels (a documented bound: their ids are broadcast, so no
text is shuffled), weighted back to the classes' true sizes.  Only word counts,
at most ``WORDS`` chosen words, and the sample's rows over them reach the driver.

Words are A-Z lower-cased runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
Edge cases: null and empty texts score as a text without chosen words; null
labels or keys are not learned from; of repeated labels of one key, each counts;
with no labels every score is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.wordhash import ALNUM, slices_by_bytes, text_buffer, words
from quire.session import ship_package

SAMPLE = 10_000      # labelled texts of each class
WORDS = 2_048        # chosen words
_STEP = 2 << 20

# Identity terms by group (English, German, French, Spanish).
IDENTITY = [
    ["women", "men", "woman", "man", "girls", "boys", "female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["black", "white", "asian", "latino", "african", "european", "american"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"],
    ["old", "young", "elderly", "teenage"], ["blind", "deaf", "disabled", "healthy"],
    ["immigrant", "refugee", "citizen", "native"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"], ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]


def _hash(terms: list[str]) -> np.ndarray:
    return words(pa.array(terms), ALNUM)[0]


def swaps() -> list[tuple[int, int]]:
    """(term, replacement) hashes: each term with the next of its group."""
    out = []
    for group in IDENTITY:
        h = [int(x) for x in _hash(group)]
        out += list(zip(h, h[1:] + h[:1], strict=True))
    return out


def _texts_words(batch):
    """(rows, word hashes, text of each word) in slices of bounded bytes."""
    for i, j in slices_by_bytes(batch.column("text"), _STEP):
        h, first = words(batch.column("text").slice(i, j - i), ALNUM)
        yield i, j, h, np.repeat(np.arange(j - i), np.diff(first))


def _present(h, of, chosen: np.ndarray):
    """Distinct (text, chosen word number) pairs."""
    at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    ok = chosen[at] == h
    return np.unique(np.stack([of[ok], at[ok]], 1), axis=0)


def _word_counts(batches):
    """Texts of each class that hold a word: (h, toxic, clean)."""
    for b in batches:
        labels = b.column("toxic").to_numpy()
        for i, j, h, of in _texts_words(b):
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, y = h[once], labels[i:j][of[once]]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.append(at, len(h)))
            toxic = np.add.reduceat(y.astype(np.int64), at) if len(h) else n
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(toxic.astype(np.int64)),
                                              pa.array((n - toxic).astype(np.int64))], ["h", "toxic", "clean"])


def choose_words(sample: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """Hashes of the words the classes hold most unevenly (chi-square against
    the classes' sizes in the sample), with the identity terms; sorted."""
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    n = F.col("toxic") + F.col("clean")
    gap = F.col("toxic") - n * share
    top = (sample.mapInArrow(_word_counts, "h long, toxic long, clean long").groupBy("h")
           .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(n >= 5)
           .orderBy(F.desc(gap * gap / n), "h").limit(WORDS).select("h").collect())
    h = np.array([r.h for r in top], dtype=np.int64).view(np.uint64)
    return np.unique(np.concatenate([h, np.array([a for a, _ in swaps()], dtype=np.uint64)]))


def _sentences_with(h, of, texts, terms):
    """Identity terms met in sentences: each (text, sentence, term) once.  A
    sentence ends at ``. ! ?`` or a line end."""
    data, offsets = text_buffer(texts)
    ends = np.isin(data, np.frombuffer(b".!?\n", np.uint8))
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    inside = ALNUM[low]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    sentence = np.cumsum(ends)[np.flatnonzero(starts)]
    ok = np.isin(h, terms)
    return np.unique(np.stack([of[ok], sentence[ok].astype(np.int64), h[ok].view(np.int64)], 1), axis=0)


def _rows(chosen: np.ndarray, terms: np.ndarray):
    def rows(batches):
        for b in batches:
            for i, j, h, of in _texts_words(b):
                pairs = _present(h, of, chosen)
                met = _sentences_with(h, of, b.column("text").slice(i, j - i), terms) if len(h) else np.empty((0, 3), np.int64)
                split = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
                met_split = np.searchsorted(met[:, 0], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column("toxic").slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(split.astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(met_split.astype(np.int32)), pa.array(met[:, 2]))],
                    ["toxic", "held", "terms"])
    return rows


def fit(held: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, int, int]],
        features: int, rounds: int = 600, rate: float = 0.2, ridge: float = 1e-5, counterfactual: float = 1.0):
    """(bias, weights) minimising weighted log loss + ridge + the mean squared
    score change over swapped sentences (``pairs``: term, replacement, times)."""
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    col = np.concatenate(held).astype(np.int64) if len(held) else np.empty(0, np.int64)
    w, total = np.zeros(features + 1), max(weight.sum(), 1e-9)
    prior = np.clip((weight * toxic).sum() / total, 1e-6, 1 - 1e-6)
    w[-1] = np.log(prior / (1 - prior))
    a, b, n = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 3
    times = max(n.sum(), 1) if len(n) else 1
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], len(held))
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / total
        g = np.append(np.bincount(col, miss[row], features) + ridge * w[:-1], miss.sum())
        if len(n):
            change = counterfactual * 2 * n * (w[b] - w[a]) / times
            np.add.at(g, b, change)
            np.add.at(g, a, -change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[-1], w[:-1]


def train(labelled: DataFrame, key: str = "doc_id", counterfactual: float = 1.0, docs: DataFrame | None = None,
          text: str = "text"):
    """``labelled``: key, toxic (0 or 1).  Returns (word hashes, weights, bias)."""
    spark = labelled.sparkSession
    ship_package(spark)
    lab = labelled.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic")).where(
        "key is not null and toxic in (0, 1)")
    sizes = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [lab.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(SAMPLE) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 x SAMPLE keys
    sample = (docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(ids, "key")
              .select("text", "toxic"))
    chosen = choose_words(sample, {y: min(n, SAMPLE) for y, n in sizes.items()})
    pairs = swaps()
    rows = sample.mapInArrow(_rows(chosen, np.array([a for a, _ in pairs], dtype=np.uint64)),
                             "toxic int, held array<int>, terms array<long>").collect()
    if not rows:
        return chosen, np.zeros(len(chosen)), -np.inf
    toxic = np.array([r.toxic for r in rows], dtype=float)
    seen = {y: max(1, int((toxic == y).sum())) for y in (0, 1)}
    weight = np.where(toxic == 1, sizes.get(1, 0) / seen[1], sizes.get(0, 0) / seen[0])
    place = {int(h): i for i, h in enumerate(chosen)}
    swap = {np.uint64(a).astype(np.int64).item(): (place[a], place[b]) for a, b in pairs}
    times: dict[tuple[int, int], int] = {}
    for r in rows:
        for t in r.terms:
            times[swap[t]] = times.get(swap[t], 0) + 1
    bias, w = fit([np.array(r.held) for r in rows], toxic, weight, [(a, b, n) for (a, b), n in times.items()],
                  len(chosen), counterfactual=counterfactual)
    return chosen, w, bias


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the classifier's probability per row, over whole texts."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        chosen, w, bias = shared.value
        for b in batches:
            z = np.full(b.num_rows, bias)
            for i, j, h, of in _texts_words(b):
                pairs = _present(h, of, chosen)
                z[i:j] += np.bincount(pairs[:, 0], w[pairs[:, 1]], j - i)
            p = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(p)], ["key", "score"])

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)
            .withColumnRenamed("key", key))
