"""Operators of a training-data pipeline, each in a module of its own, with their queries and SQL."""
