"""Text-signal analytics on Spark: headlines in, tested daily signals out."""

__version__ = "0.1.0"
