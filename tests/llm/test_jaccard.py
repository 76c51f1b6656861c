"""The Jaccard join and connected components against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from quire.llm import jaccard_join as jj, queries as Q
from quire.llm.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows, k=5, percent=80):
    """rows of (unique row number, text) -> row number: (set size, root)."""
    rx, sets = re.compile("[^\x20\x09-\x0D]+"), {}
    for i, t in rows:
        w = rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(k, len(w))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        common.update((a, b) for n, a in enumerate(h) for b in h[:n])
    links = [(a, b) for (a, b), c in common.items()
             if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text) for r in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op6(spark, SF_SMALL).collect()}
    assert got == want and any(i != r for i, (_, r) in want.items())


def crowd(seed):
    """Chains of edits, a large group of near copies, a passage in many texts,
    short texts and exact copies."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(30)]
    out = ["", None, " \n", "one two", "One  two", "one two three", passage[0]]
    base = [word() for _ in range(60)]
    for _ in range(90):
        t = list(base)
        t[rng.randrange(60)] = word()
        out.append(" ".join(t))
    for _ in range(60):
        out.append(" ".join([word() for _ in range(rng.randrange(10, 60))] + passage))
    chain = [word() for _ in range(80)]
    for _ in range(30):
        chain = chain[1:] + [word()]
        out.append(" ".join(chain))
    rng.shuffle(out)
    return out + out[:40]


@pytest.mark.parametrize("seed,cell,frequent", [(1, 50_000, 64), (2, 20, 8), (3, 20, 10**9)])
def test_groups_passages_and_split_cells(spark, monkeypatch, seed, cell, frequent):
    monkeypatch.setattr(jj, "CELL", cell)
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    rows = list(enumerate(crowd(seed)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows],
                                 "doc_id long, text string, uid string, root string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_classes(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "A b\tc"), (5, "A b\tc"), (None, None), (None, "lone"),
                                  (7, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.jaccard_classes(docs).collect())
    assert got == sorted([("None", 1, "5"), ("5", 1, "5"), ("5", 1, "5"), ("None", 0, "None"),
                          ("None", 1, "None"), ("7", 0, "7")])
    assert jj.jaccard_classes(docs.limit(0)).count() == 0


def test_rtree_join_misses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 400)).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate((s[:int(len(s) * 0.92)], s[:0]))) for s in sets[:40]]
    sizes = np.array([len(s) for s in sets])
    found = set()
    points = [jj.point(s) for s in sets]
    for a, b, cut in jj.cell_pairs(points, sizes, np.arange(len(sets)), 80):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a, b)}
        assert not cut
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 180 * c >= 80 * (sizes[i] + sizes[j]):
                assert (j, i) in found
    assert len(found) < 300


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr("quire.llm.components.BLOCK", block)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)]
    links += [(1000, n) for n in range(1001, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n in got}
    assert all(n in got for p in links if p[0] != p[1] for n in p)


def test_components_that_do_not_settle_fail(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.components.BLOCK", 10)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, rounds=1)


def test_limited_join_says_what_it_cut():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[:290], rng.integers(0, 1 << 63, 10).astype(np.uint64)))) for _ in range(200)]
    sizes = np.array([len(s) for s in sets])
    got = list(jj.cell_pairs([jj.point(s) for s in sets], sizes, np.arange(200), 80, limit=3))
    assert any(cut for _, _, cut in got) and 200 <= sum(len(a) for a, _, _ in got) <= 600
    assert len(set(roots(range(200), [(x, y) for a, b, _ in got for x, y in zip(a, b)]).values())) == 1


def test_points_pack_in_any_width():
    for top in (3, 15, 16, 255, 256, 70_000):
        c = np.arange(16) * top // 15
        assert np.array_equal(jj.unpack_point(jj.pack_point(c)), c)
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 900).astype(np.uint64))
    p = jj.point(a)
    assert p.sum() == len(a) and np.array_equal(jj.fold(p[None], len(p) // 4)[0], p.reshape(4, -1).sum(0))
