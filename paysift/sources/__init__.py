"""Readers and writers: driver tables, the postings view, CSV/Parquet/JSON files."""
