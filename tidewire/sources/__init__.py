"""Sources and sinks: landed JSON, prices, the headline and score tables, result tables."""

from .landed import read_listing, read_news, read_prices, read_rejected, rejected
from .tables import (
    append_headlines,
    append_scores,
    create_store,
    read_headlines,
    read_scores,
    save_bucketed,
    write_results,
)

__all__ = [
    "append_headlines", "append_scores", "create_store", "read_headlines", "read_listing", "read_news",
    "read_prices", "read_rejected", "read_scores", "rejected", "save_bucketed", "write_results",
]
