"""paysift — Spark-native compensation analytics.

Composable DataFrame operators (``paysift.operators``), column helpers
(``paysift.functions``), table readers and writers (``paysift.sources``),
composed marts and the query registry (``paysift.plans``) and a
Structured Streaming rollup (``paysift.streaming``).
"""

__version__ = "0.1.0"
