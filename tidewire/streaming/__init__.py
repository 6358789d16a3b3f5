"""Continuous forms of ingest, scoring and the daily aggregate."""

from .daily import daily_partials_stream, daily_stream, stored_daily
from .ingest import ingest_batch, ingest_stream

__all__ = ["daily_partials_stream", "daily_stream", "ingest_batch", "ingest_stream", "stored_daily"]
