"""Daily sentiment over a stream of scored headlines: exact by partial sums, or windowed with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import utc_day
from ..operators.daily import daily_from_partials, daily_partials
from ..sources.tables import add_daily_partials, read_daily_partials


def daily_stream(scored: DataFrame, delay: str = "1 day") -> DataFrame:
    """The streaming form of ``daily_sentiment``: one row per ticker and closed UTC day.

    In append mode a day comes out once the watermark has passed its end; rows later than
    ``delay`` are dropped, and copies of a (source, url) are recognized within that delay only.
    `daily_partials_stream` has neither limit; this form is for consumers of closed days only.

    ``published_at`` is an instant (Spark takes no zone-less time as event time).
    """
    def mean(name: str):
        return F.avg(F.nanvl(F.col(name), F.lit(None).cast("double")))

    return (
        scored.where("ticker is not null and published_at is not null")
        .withWatermark("published_at", delay)
        .dropDuplicatesWithinWatermark(["source", "url"])
        .groupBy("ticker", F.window("published_at", "1 day").alias("day"))
        .agg(
            mean("score").alias("sentiment"),
            F.count(F.lit(1)).alias("n"),
            mean("confidence").alias("confidence"),
        )
        .select("ticker", utc_day(F.col("day.start"), T.TimestampType()).alias("date"), "sentiment", "n", "confidence")
    )


def daily_partials_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the partials of each batch to those of their days below ``path``, then stops.

    A batch rewrites the days it has rows of, however late they are, and there is one file a day whatever the number of batches. A batch that runs
    again counts once. The path belongs to one checkpoint. Rows should be those that `insert_if_absent` let through: copies that are in the
    stream count.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        add_daily_partials(daily_partials(batch), path, batch_id)

    return scored.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_daily(spark, path: str) -> DataFrame:
    """The complete daily table from all partials below a path."""
    return daily_from_partials(read_daily_partials(spark, path))
