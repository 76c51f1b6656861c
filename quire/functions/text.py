"""Scalar text functions.

Python's ``str.split``/``strip``/``re`` ``\\s`` are Unicode-aware and also
treat the four information separators U+001C..U+001F as whitespace.  Java's
``(?U)\\s`` covers everything else, so the character class below matches
exactly the set Python uses.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values ------------------------------------------------------------
# Whitespace class equal to Python's str.isspace() set.
WS_CLASS = r"[\s\x1c-\x1f]"
# ... and its members.
WS_CHARS = ("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Whole-cell tokens that pandas.read_csv turns into null by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Code-table sentence template: ICD [VERSION] code for [CODE]: [DESCRIPTION]
CODE_TEXT_TEMPLATE = "ICD %s code for %s: %s"
# -------------------------------------------------------------------------

_WS_RUN = "(?U)" + WS_CLASS + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Collapse every whitespace run to one space and strip; null stays null."""
    return F.trim(F.regexp_replace(_c(c), _WS_RUN, " "))


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def word_count(c) -> Column:
    """Number of whitespace-separated words (``len(s.split())``); '' -> 0."""
    return F.regexp_count(_c(c), F.lit("(?U)[^\\s\\x1c-\\x1f]+")).cast("long")


def split_words(c) -> Column:
    """``s.split()`` as an array: runs of whitespace separate, edges ignored."""
    return F.array_remove(F.split(_c(c), _WS_RUN), "")


def first_words(c, n: int) -> Column:
    """``s.split()[:n]``; the text behind these words is not split."""
    # one piece more for whitespace at the start, one for the rest
    return F.slice(F.array_remove(F.split(_c(c), _WS_RUN, n + 2), ""), 1, n)


def na_to_null(c) -> Column:
    """Whole-cell NA tokens become null, as ``pandas.read_csv`` does."""
    col = _c(c)
    return F.when(col.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def code_text(version, code, description, suffix: str = "") -> Column:
    """``ICD {version} code for {code}: {description}`` (+ optional suffix,
    e.g. the '.' of the documented example)."""
    out = F.format_string(CODE_TEXT_TEMPLATE, _c(version), _c(code), _c(description))
    return F.concat(out, F.lit(suffix)) if suffix else out


def combine_title_abstract(title, abstract) -> Column:
    """Both non-empty -> 'title abstract'; else whichever is non-empty; else null."""
    t, a = _c(title), _c(abstract)
    t_ok = t.isNotNull() & (t != "")
    a_ok = a.isNotNull() & (a != "")
    return (F.when(t_ok & a_ok, F.concat(t, F.lit(" "), a))
            .when(t_ok, t).when(a_ok, a)
            .otherwise(F.lit(None).cast("string")))
