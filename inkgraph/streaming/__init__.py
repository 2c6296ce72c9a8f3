"""Watching a corpus: link tables that grow as a stream."""
