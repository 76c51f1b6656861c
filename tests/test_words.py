"""Words and edges of a text, against Python's split and strip over every kind of whitespace."""

from pyspark.sql import functions as F

from quire.functions.text import WS_CHARS, first_words, py_strip, split_words
from quire.operators.tokens import SPECIALS, build_vocabulary

SPACES = [chr(i) for i in range(0x110000) if chr(i).isspace()]
TEXTS = ["", " ", "a", *[f"{s}a{s}{s}b {s}c{s}" for s in SPACES], "a b", "a b ", " a b c", "a b c d", "\n\t a​b", *SPACES]


def test_words_and_edges(spark):
    assert sorted(WS_CHARS) == SPACES
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    cols = [split_words("t"), py_strip("t"), *[first_words("t", n) for n in range(5)]]
    for r in df.select("t", *cols).collect():
        want = [None] * 7 if r.t is None else [r.t.split(), r.t.strip(), *[r.t.split()[:n] for n in range(5)]]
        assert list(r[1:]) == want, repr(r.t)


def test_special_words_are_left_out_of_the_vocabulary(spark):
    df = spark.createDataFrame([("[MASK] a <dummy_extra_token_7> a [MASK]",), ("b [PAD]",)], "clinical_text string")
    got = [(r.token, r.count_) for r in build_vocabulary(df).withColumnRenamed("count", "count_").collect()]
    assert sorted(got, key=str) == sorted([*[(s, None) for s in SPECIALS], ("a", 2), ("b", 1)], key=str)
