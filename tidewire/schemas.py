"""Table schemas. Every table is declared; nothing is inferred from data.

Names and order of the columns are fixed values: the contract of the tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

HEADLINES = T.StructType([
    T.StructField("headline_id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("published_at", T.TimestampType(), False),
    T.StructField("publisher", T.StringType(), True),
])

SCORES = T.StructType([
    T.StructField("headline_id", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("model", T.StringType(), False),
])

SCORED_COLUMNS = [
    "ticker", "title", "url", "source", "published_at", "publisher",
    "label", "score", "confidence", "model",
]

FEED_COLUMNS = [
    "published_at", "ticker", "source", "label", "score", "title", "publisher", "url",
]

DAILY = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("sentiment", T.DoubleType(), True),
    T.StructField("n", T.LongType(), False),
    T.StructField("confidence", T.DoubleType(), True),
])

#: Sums and counts of a ticker's day, and the last batch that the day took in (see `add_daily_partials`).
PARTIALS = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("score_sum", T.DoubleType(), True),
    T.StructField("score_n", T.LongType(), True),
    T.StructField("confidence_sum", T.DoubleType(), True),
    T.StructField("confidence_n", T.LongType(), True),
    T.StructField("n", T.LongType(), True),
    T.StructField("applied", T.LongType(), True),
    T.StructField("date", T.DateType(), True),
])

PRICES = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("close", T.DoubleType(), True),
])

LEXICON = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("valence", T.DoubleType(), False),
])

PROBABILITIES = T.MapType(T.StringType(), T.DoubleType())
