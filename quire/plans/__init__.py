"""Composed flows (corpus build, training preparation, embedding run) and
the query registry used by ``__spark_entry__``."""
