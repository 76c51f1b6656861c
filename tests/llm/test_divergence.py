"""Source divergence against plain integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from quire.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def plain(rows, least, most=10):
    """The contract, term by term."""
    in_docs, n, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        lang = lang or ""
        n[lang, source or ""].update(found)
        lang_n[lang].update(found)
        in_docs[lang].update(set(found))
    kept = {x: sorted(t for t in in_docs[x] if in_docs[x][t] >= least) for x in {a for a, _ in n}}
    out = set()

    def p(count, total, v):
        return 1 + 10**9 * (count + 2) // (total + 2 * v)

    def f(x, y):
        return (x - y) ** 2 // (x + y)

    def rank(lang, source, part, values, top):
        for i, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))):
            if top is None or i < top:
                out.add((lang, source, part, item, v, i + 1))

    for lang, source in n:
        terms = kept[lang]
        total = {s: sum(n[lang, s][t] for t in terms) for x, s in n if x == lang}
        whole = sum(lang_n[lang][t] for t in terms)
        mine = {t: p(n[lang, source][t], total[source], len(terms)) for t in terms}
        rank(lang, source, "pair", [(sum(f(mine[t], p(n[lang, s][t], total[s], len(terms))) for t in terms), s)
                                    for s in total if s != source], None)
        rank(lang, source, "term", [(f(mine[t], q), t) for t in terms if n[lang, source][t]
                                    and mine[t] > (q := p(lang_n[lang][t], whole, len(terms)))], most)
    return out


def got(df, **kw):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in D.source_divergence(df, **kw).collect())


def test_equals_plain_arithmetic_in_any_segments_and_tiles(spark):
    rng = random.Random(5)
    words = [a + b for a in "aäbcdeéZ" for b in ["", "x", "Y", "ß", "zz"]]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s0"] * 6 + [f"s{k}" for k in range(9)] + [None, "é"])
        text = " ".join(rng.choice(words[:rng.randrange(1, len(words))]) for _ in range(rng.randrange(30)))
        rows.append((i, rng.choice([text, text + "1_2.Done", None, ""]), lang, source, "t", 1))
    rows += [rows[3]] * 40 + [(900, "Lonely lonely", "xx", "only", "t", 1), (901, "", "yy", "a", "t", 1), (902, None, "yy", "b", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = sorted(plain(rows, 10))
    assert got(df) == expected
    assert got(df, segment=7, tile=2) == expected
    assert got(df.repartition(5), segment=16, tile=3) == expected
    assert ("yy", "a", "pair", "b", 0, 1) in expected and not any(r[0] == "xx" for r in expected)
    assert got(df, least=1, most=3) == sorted(plain(rows, 1, 3))


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_a_very_long_text_and_flushed_counts(spark, monkeypatch):
    text = "alpha beta " * 300_000 + "x" * 2_000_000 + " omega" * 10
    rows = [(i, text if i == 3 else "alpha beta omega gamma", "en", f"s{i % 3}", "", 0) for i in range(12)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted(plain(rows, 10))
    pieces = list(D.terms(text.encode()))
    assert len(pieces) > 2 and sum(map(len, pieces)) == 600_011


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.data())
def test_runs_and_intersection(column, data):
    other = data.draw(st.lists(st.integers(0, 3), min_size=len(column), max_size=len(column)))

    def encoded(c):
        at = np.array([i for i, x in enumerate(c) if x], np.int64)
        starts, values = D.runs_of(at, np.array([x for x in c if x], np.int64), len(c))
        assert [int(values[np.searchsorted(starts, i, side="right") - 1]) for i in range(len(c))] == c
        assert (np.diff(values) != 0).all()
        return starts, D.shares(values, max(1, sum(c) + 2 * len(c)))

    a, b = encoded(column), encoded(other)
    total = [max(1, sum(c) + 2 * len(c)) for c in (column, other)]
    p = [[1 + 10**9 * (x + 2) // t for x in c] for c, t in zip((column, other), total)]
    assert D.divergence(a, b, len(column)) == sum((x - y) ** 2 // (x + y) for x, y in zip(*p))


def test_shares_beyond_64_bits():
    counts = [0, 1, 10**10, 10**14, 9 * 10**14]
    total = 10**15 + 7
    assert D.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]


def test_equal_counts_lie_together(spark):
    # 60 terms in a, 60 in b, each once a document: two runs, in either column
    rows = [(i, " ".join(f"{s}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)), "en", s, "", 0)
            for s in "ab" for i in range(10)]
    runs = D.Audit(spark.createDataFrame(rows, SCHEMA)).columns().collect()
    assert [(len(r.starts), r.length) for r in runs] == [(2, 120)] * 2
