"""Token counts, packing and the inverted index against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from conftest import SF_SMALL
from quire.llm import bpe, inverted_index as ii, queries as Q, token_counts as tc
from quire.llm.packing import SlackPacker, closest_fill, pack_tokens
from quire.llm.wordhash import ALNUM, NON_SPACE, shingles, words

ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (None, "one two", "b"), (4, "same text here", "a"),
       (4, "same text here", "a"), (5, "x" * 30000, "b"), (6, "the <|endoftext|> ünï 語   \x85 end", None)]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, content string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F, blacklist_categories=("Cs",)), max_size=80))
def test_encoder_equals_library(text):
    from tokenizers import Tokenizer
    enc = bpe.encoder(bpe.read_json(bpe.default_path()))
    assert enc._fast is not None
    lib = Tokenizer.from_file(bpe.default_path()) if not hasattr(bpe, "_t") else bpe._t
    bpe._t = lib
    assert enc.ids(text) == lib.encode(text, add_special_tokens=False).ids


def test_word_hash_equals_regex():
    texts = ["Ab c-d\x85é 9", None, "", "a b", "日本 ab\tab", "x" * 5000 + " y"]
    for lut, rx in ((NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, first = words(pa.array(texts), lut)
        seen = {}
        for i, t in enumerate(texts):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            want = re.findall(rx, low)
            got = h[first[i]:first[i + 1]]
            assert len(want) == len(got)
            for w, x in zip(want, got):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
    assert len(shingles(h[:0], 5)) == 0 and len(shingles(h[:3], 5)) == 1


def test_counts_use_and_fill_the_cache(spark, library, tmpdir_path):
    cache = f"{tmpdir_path}/cache"
    docs = frame(spark)
    for _ in range(2):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in
                     tc.token_counts(docs, cache, keep=("doc_id", "content")).collect())
        want = sorted((i or -1, len((t or "").encode()),
                       len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in ODD})
    assert tc.token_counts(docs.limit(0), cache).count() == 0


def test_closest_fill_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5))}
        space = int(rng.integers(0, 60))
        got = closest_fill(counts, sorted(counts), space)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert all(k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= space)


def test_packer_places_every_id_once_without_padding():
    rng = np.random.default_rng(5)
    out = {}
    packer = SlackPacker(64, lambda p, s, o: out.setdefault(s, []).append((o, p)), pool_tokens=500)
    docs = [np.arange(n, dtype="<u4") for n in [*rng.integers(1, 200, 300), 64, 64, 1]]
    for i, d in enumerate(docs):
        packer.offer(i, d)
    packer.close()
    parts = {}
    for s, pieces in out.items():
        at = 0
        for o, (i, start, ids) in pieces:
            assert o == at
            at += len(ids)
            parts.setdefault(i, []).append((start, ids))
        assert at == 64 or at & (at - 1) == 0
    for i, d in enumerate(docs):
        assert np.array_equal(np.concatenate([x for _, x in sorted(parts[i], key=lambda p: p[0])]), d)


def test_packing_query_round_trip(spark, library):
    rows = Q.op2(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for i, pieces in by.items():
        ids = library.encode(docs[i] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_packing_edges(spark):
    got = pack_tokens(frame(spark)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in got}[1] == 1
    assert pack_tokens(frame(spark).limit(0)).count() == 0


def brute(docs, items, width=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    win = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            win.setdefault(tuple(w[k:k + width]), set()).add(str(i))
    sizes = {len(x) for x in win}
    out = []
    for i, t in docs:
        w, hit, named = low(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in win:
                    hit |= set(range(k, k + n))
                    named |= win[x]
        out.append((i, len(w), len(hit), len(named),
                    hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, items)
    got = sorted((tuple(r) for r in Q.op3(spark, SF_SMALL).collect()), key=str)
    assert got == want and any(r[5] for r in got)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_contamination_edges(spark, monkeypatch, block):
    monkeypatch.setattr(ii, "BLOCK_BYTES", block)
    docs = [(1, None), (2, ""), (3, "a b a b a b a b a b a b a b"), (None, "x y"), (4, "A, b! a"), (4, "A, b! a"),
            (5, "one TWO three four five six seven eight nine ten eleven"), (6, "b a " * 40)]
    items = [(7, "a b a b a b a b a b a"), (8, None), (9, ""), (10, "x y"), (11, "a b a"), (7, "two three"),
             (None, "nine ten")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = ii.contamination(d, b).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got), key=str)
    want = sorted((r[:4] for r in brute(docs, [x for x in items if x[0] is not None] + [(-1, "nine ten")])), key=str)
    want = [(i, n, h, k - (i == 5)) for i, n, h, k in want]  # a null item id names no item
    assert got == want
    assert ii.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert ii.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x x beta"), (3, "alpha")],
                              "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(1, "beta alpha")], "item_id long, text string")
    got = ii.search(ii.build_index(d), b, within=3).collect()
    assert [r.ord for r in got] == [0]
