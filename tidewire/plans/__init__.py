"""Compositions: the end-to-end run and the dashboard tables."""

from .dashboard import dashboard_tables
from .end_to_end import RunConfig, run_end_to_end

__all__ = ["RunConfig", "dashboard_tables", "run_end_to_end"]
