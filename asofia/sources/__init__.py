"""Readers, ingest rules, keyed writes and sinks."""
