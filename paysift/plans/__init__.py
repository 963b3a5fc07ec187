"""Composed plans (marts) and the query registry used by ``__spark_entry__``."""
