"""Quality rules against a plain Python version."""

import re
from collections import Counter, defaultdict

from conftest import SF_SMALL
from quire.llm import queries as Q
from quire.llm.quality import quality_rules

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, share=0.01, least=20):
    """rows of (id, text, host) -> sorted result tuples."""
    held, per_host = defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub("[0-9]+", "0", " ".join(WORD.findall(x)).lower())
    for _, t, h in rows:
        per_host[h].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                held[h, norm(x)].add(t or "")
    out = []
    for i, t, h in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        hit = {j + o for j in range(len(w) - 7) if windows[tuple(w[j:j + 8])] > 1 for o in range(8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        gone = sum(len(WORD.findall(x)) for x in lines
                   if len(held[h, norm(x)]) > max(least, share * len(per_host[h])))
        left = len(w) - gone
        kept = not failed and not (gone and (left < 20 or left < 0.3 * len(w)))
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                    len(hit), failed, kept, gone))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in Q.op10(spark, SF_SMALL).collect()), key=str) == brute(rows)


def test_boilerplate_copies_and_edges(spark):
    letters = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    long = " ".join("w" + letters(i) for i in range(30))
    rows = [(i, f"Site  header {i} and nothing more to it\n{long} x{letters(i)} y\r\x0b", "a") for i in range(60)]
    rows += [(100 + i, "Site header 7 and nothing more to it\nshort tail " + " ".join(letters(j) + letters(i) for j in range(13)), "a") for i in range(30)]
    rows += [(200 + i, "a copied text\n" + long, "b") for i in range(80)]
    rows += [(300, None, "a"), (301, "", None), (302, "  \n\n\t", None), (None, long, None), (303, "r e p " * 40, None),
             (304, "a b c d e f g h " * 2 + long, "c"), (305, "é#*$ |<> " * 9, "c"), (305, "é#*$ |<> " * 9, "c"),
             (306, "z" * 100_000 + " " + "tick tock " * 9000, "c")]
    docs = spark.createDataFrame([r + ("clash",) * 4 for r in rows],
                                 "doc_id long, text string, source string, words string, lines string, host string, key string")
    got = quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept", "n_line_words").collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    by = {r[0]: r for r in want}
    assert by[5][7] and not by[105][7] and by[205][7]  # header removed; depleted; copies stay
    assert quality_rules(docs.limit(0)).count() == 0


def test_lines_above_the_limit_leave_the_text(spark):
    import corpus_pipeline as P
    letters = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    long = " ".join("w" + letters(i) for i in range(30))
    own = lambda i: f"{long} x{letters(i)} y"
    rows = [(i, f"\n Site  header {i}\n\n{own(i)}\nsite HEADER 7\n", "en", "a") for i in range(60)]
    rows += [(100 + i, "Site header 7 " + "z" * i + "\n" + own(i), "en", "b") for i in range(15)]
    rows += [(200 + i, "\n Site  header 3\n\n" + own(3), None, None) for i in range(40)]
    rows += [(0, rows[0][1], "en", "a"), (300, "Site header 1\nshort " + own(1)[:40], "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    got = P.quality(spark, docs, "")
    assert got.schema == docs.schema
    want = [(i, f"\n\n{own(i)}\n", "en", "a") for i in [*range(60), 0]] + rows[60:115]
    assert sorted(tuple(r) for r in got.fillna("", ["lang", "source"]).collect()) == sorted(
        (i, t, lang or "", s or "", len(t)) for i, t, lang, s in want)
