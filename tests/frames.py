"""Helpers that tests import; fixtures are in conftest."""


def rows(frame, *order):
    """Rows as tuples, sorted by the given columns (all by default)."""
    return [tuple(row) for row in frame.orderBy(*(order or frame.columns)).collect()]
