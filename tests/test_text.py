"""T1, T6, NA tokens, strip, code text, title/abstract combination."""

import pytest
from pyspark.sql import functions as F

from quire.functions.text import (NA_TOKENS, clean_text, code_text, combine_title_abstract,
                                  na_to_null, py_strip, split_words, word_count)

WS_CASES = [" a\n\tb \r\n", "x y", "p q", "m\u001cn", "u\u0085v", "", "  \t\n ",
            "no-space", "a  b   c", "　lead", "trail ", "\u001f\u001e"]


def _py_clean(s):
    # the reference rule written out independently: collapse runs, strip
    return " ".join(s.split()) if s is not None else None


def test_clean_text_matches_python_unicode_whitespace(spark):
    df = spark.createDataFrame([(s,) for s in WS_CASES] + [(None,)], "t string")
    got = [r[0] for r in df.select(clean_text("t")).collect()]
    assert got == [_py_clean(s) for s in WS_CASES] + [None]


def test_word_count_and_split(spark):
    df = spark.createDataFrame([(s,) for s in WS_CASES], "t string")
    rows = df.select(word_count("t").alias("n"), split_words(F.col("t")).alias("w")).collect()
    assert [r.n for r in rows] == [len(s.split()) for s in WS_CASES]
    assert [list(r.w) for r in rows] == [s.split() for s in WS_CASES]


def test_py_strip(spark):
    df = spark.createDataFrame([(s,) for s in WS_CASES], "t string")
    assert [r[0] for r in df.select(py_strip("t")).collect()] == [s.strip() for s in WS_CASES]


def test_every_bmp_whitespace_char(spark):
    chars = [chr(c) for c in range(0x10000) if not (0xD800 <= c <= 0xDFFF)]
    ws = "".join(c for c in chars if c.isspace())
    df = spark.createDataFrame([("a" + ws + "b",), (ws,)], "t string")
    assert [r[0] for r in df.select(clean_text("t")).collect()] == ["a b", ""]


@pytest.mark.parametrize("cell", NA_TOKENS)
def test_na_tokens_become_null(spark, cell):
    df = spark.createDataFrame([(cell,)], "t string")
    assert df.select(na_to_null("t")).first()[0] is None


def test_na_padded_cell_is_kept(spark):
    df = spark.createDataFrame([(" NA ",), ("NAN",), ("n/a ",)], "t string")
    assert [r[0] for r in df.select(na_to_null("t")).collect()] == [" NA ", "NAN", "n/a "]


def test_code_text_template(spark):
    df = spark.createDataFrame([("9", "250.00", "Diabetes mellitus")], "v string, c string, d string")
    assert df.select(code_text("v", "c", "d")).first()[0] == "ICD 9 code for 250.00: Diabetes mellitus"
    assert df.select(code_text("v", "c", "d", ".")).first()[0] == "ICD 9 code for 250.00: Diabetes mellitus."


@pytest.mark.parametrize("title,abstract,expected", [
    ("T", "A", "T A"), ("T", "", "T"), ("T", None, "T"), ("", "A", "A"), (None, "A", "A"),
    ("", "", None), (None, None, None), (" ", "", " "),
])
def test_title_abstract_combination(spark, title, abstract, expected):
    df = spark.createDataFrame([(title, abstract)], "t string, a string")
    assert df.select(combine_title_abstract("t", "a")).first()[0] == expected
