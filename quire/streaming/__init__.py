"""Incremental ingest (X1) with Structured Streaming."""

from quire.streaming.ingest import ingest_notes_stream, ingest_articles_stream  # noqa: F401
