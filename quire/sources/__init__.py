"""Readers and writers (S1-S8) and fixture renderers."""

from quire.sources.notes import read_notes  # noqa: F401
from quire.sources.articles import read_articles, parse_article_records  # noqa: F401
from quire.sources.codes import read_code_table  # noqa: F401
from quire.sources.patients import read_patients  # noqa: F401
from quire.sources.sinks import write_corpus, read_corpus, write_tokenized  # noqa: F401
