"""Incremental landing of newly arriving CSV exports (Structured Streaming)."""

from tillroll.streaming.landing import land_csv_stream

__all__ = ["land_csv_stream"]
