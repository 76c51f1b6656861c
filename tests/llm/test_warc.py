"""Revisit resolution against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm.warc import canonical_url, merge_headers, resolve_revisits

SCHEMA = ("id long, url string, time long, kind string, etag string, last_modified string, digest string, "
          "headers map<string,string>, payload string, extra int")


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Ex.com:80/a/?utm_source=x&b=2&a=1#top", "ex.com/a?a=1&b=2"), ("https://ex.com", "ex.com"),
    ("https://ex.com/index.html", "ex.com"), ("ex.com/A/?ref=z", "ex.com/A"), ("", ""), (None, None)])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def test_merge_headers(spark):
    d = spark.createDataFrame([({"etag": "1", "content-type": "a"}, {"etag": "2", "content-type": "b", "vary": None}), (None, None)],
                              "s map<string,string>, t map<string,string>")
    got = [r[0] for r in d.select(merge_headers(F.col("s"), F.col("t"))).collect()]
    assert got == [{"etag": "2", "content-type": "a"}, {}]


def loop(rows):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [s for s in rows if s[3] == "response" and s[1] is not None and s[1] == r[1]
                  and ((s[2] is not None, s[2] or 0), s[0]) < ((r[2] is not None, r[2] or 0), r[0])]
        if not before:
            out.append((r[0], None, "unresolved", None))
            continue
        s = max(before, key=lambda s: ((s[2] is not None, s[2] or 0), s[0]))
        if r[4] is not None:
            same = s[4] is not None and r[4].removeprefix("W/") == s[4].removeprefix("W/")
        elif r[5] is not None:
            same = r[5] == s[5]
        else:
            same = r[6] is not None and r[6] == s[6]
        out.append((r[0], s[0], "resolved" if same else "changed", s[8] if same else None))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 2, 16])
def test_equals_a_loop(spark, slices):
    rng = random.Random(slices)
    rows = []
    for i in range(400):  # half of all captures are of one URL; times tie
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        rows.append((i, rng.choice(["hot.com/x"] * 5 + ["b.com", "c.com/q", None]), rng.choice([None, rng.randrange(60)]),
                     rng.choice(["response", "revisit", "revisit", "request"]), tag, rng.choice([None, "d1", "d2"]),
                     rng.choice([None, "s1", "s2"]), {"date": str(i)}, f"p{i}", 0))
    rows += rows[:20]  # repeated rows count once
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(5), slices).collect()
    assert sorted((r.id, r.response_id, r.verdict, r.payload) for r in got) == loop(rows[:400])
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
