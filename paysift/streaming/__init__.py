"""Structured Streaming: incremental rollups over the append-only request log."""
