"""Readers, sinks, artifact store and keyed upsert."""

from .readers import read_table, read_text_lines, read_csv, read_first_existing, read_shards  # noqa: F401
