"""tokentally: developer-tool telemetry analytics on Spark DataFrames.

Layers
------
sources/    schemas, raw JSONL/CSV ingest with rejects, curated Parquet tables,
            batch-packing sinks, and the mapping from the driver's test tables.
functions/  small Column helpers (dates, weekday names, level order, safe ratios).
operators/  filters + dimension join, session-cost roll-up, reshaping, forecasting.
plans/      the 27 analytics queries, each ``(Tables, Filters) -> DataFrame``.
streaming/  Structured Streaming ingest and watermarked daily cost.
"""

from tokentally.operators.filters import Filters
from tokentally.sources.tables import Tables

__all__ = ["Filters", "Tables"]
