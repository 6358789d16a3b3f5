"""Raw inputs as they land: news items, forum listings, daily closes.

Fetching over the network is left to whatever lands the files. A feed that failed has no lines,
and a line that is not JSON has no row, so one bad feed never stops the others; `rejected` lists such lines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PRICES


def arrival(file: Column, block: Column, line: Column) -> Column:
    """Arrival order of a row: file, block in the file, line in the block, post in the line, mention.

    One struct type for all sources, so that their rows can be united and compared.
    """
    return F.struct(
        file.cast("string").alias("file"),
        block.cast("bigint").alias("block"),
        line.cast("bigint").alias("line"),
        F.lit(0).alias("pos"),
        F.lit("").alias("mention"),
    )


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # The row number of a scan only orders lines inside one block, so the order does not depend
    # on how files are packed into tasks, or on retried tasks.
    seq = arrival(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    return spark.read.text(path).select("value", seq.alias("seq"))


def _parsed(text: str) -> Column:
    """A JSON line as VARIANT. As the output of a generator it is parsed once: a plain expression
    would be pushed into every filter on its fields, and parsed again there."""
    return F.explode(F.array(F.try_parse_json(text)))


def _counted(lines: DataFrame, counts: Observation) -> DataFrame:
    """Lines (value, seq) -> seq, raw VARIANT; lines and rejected lines are counted as they pass. What is observed is computed once."""
    no_json = F.col("raw").isNull() & (F.trim("value") != "")
    parsed = lines.select("seq", "value", F.try_parse_json("value").alias("raw"))
    return parsed.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(no_json).alias("rejected"))


def parse_news(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Lines ``{"ticker": ..., "item": {...}}`` (value, seq) -> ticker, seq, item VARIANT.

    Items stay VARIANT so that a JSON number and the same digits as text can be told apart. ``counts`` observes ``lines`` and ``rejected``.
    """
    parsed = lines.select("seq", _parsed("value").alias("raw")) if counts is None else _counted(lines, counts)
    return (
        parsed.select(
            F.try_variant_get("raw", "$.ticker", "string").alias("ticker"),
            "seq",
            F.try_variant_get("raw", "$.item", "variant").alias("item"),
        )
        .where("ticker is not null and item is not null")
    )


def parse_listing(lines: DataFrame) -> DataFrame:
    """Lines holding one listing each (value, seq) -> seq, post VARIANT, one row per post."""
    children = F.try_variant_get(F.try_parse_json("value"), "$.data.children", "array<variant>")
    # The generator is the barrier here.
    return lines.select("seq", F.posexplode(children).alias("pos", "child")).select(
        F.col("seq").withField("pos", F.col("pos")).alias("seq"),
        F.try_variant_get("child", "$.data", "variant").alias("post"),
    )


def rejected(lines: DataFrame) -> DataFrame:
    """The lines (value, seq) that hold no JSON, which `parse_news` and `parse_listing` pass over; empty lines are none."""
    return lines.where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))


def read_rejected(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return rejected(_lines(spark, path))


def read_news(spark: SparkSession, path: str | list[str], counts: Observation | None = None) -> DataFrame:
    return parse_news(_lines(spark, path), counts)


def read_listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_listing(_lines(spark, path))


def select_prices(
    prices: DataFrame,
    tickers: Iterable[str] | None = None,
    start: str | Column | None = None,
    end: str | Column | None = None,
) -> DataFrame:
    """Closes of the wanted tickers over ``[start, end)``; the bounds may be scalar subqueries."""
    def bound(value: str | Column) -> Column:
        return F.lit(value).cast("date") if isinstance(value, str) else value

    if tickers is not None:
        prices = prices.where(F.col("ticker").isin(list(tickers)))
    if start is not None:
        prices = prices.where(F.col("date") >= bound(start))
    if end is not None:
        prices = prices.where(F.col("date") < bound(end))
    return prices.select("date", "ticker", "close")


def read_prices(
    spark: SparkSession,
    path: str,
    tickers: Iterable[str] | None = None,
    start: str | Column | None = None,
    end: str | Column | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Adjusted daily closes from parquet, CSV (with header), ORC or JSON lines.

    Tickers without data are simply absent. A table partitioned by date is pruned by the bounds.
    """
    # File readers hand nullable columns back whatever the schema says.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in PRICES])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return select_prices(reader.format(fmt).load(path), tickers, start, end)
