"""The stored tables: bucketed headlines and scores, daily partials by day, results."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HEADLINES, PARTIALS, SCORES
from ..session import local_frame, materialize

#: Headlines and scores are bucketed by it, so that joins of the two, and set logic on it, leave the history where it is.
STORE_KEY = "headline_id"
LAYOUT = "buckets int"
#: Folders that a table of daily partials has at most; beyond, days share one, as few as is enough. A folder costs a file to write and open, and a listing.
MOST_FOLDERS, WIDTHS, WIDTH = 512, (1, 8, 64, 512, 4096, 32768), "days int"

#: Buckets of the stores that this process has seen.
_buckets: dict[str, int] = {}


def create_store(spark: SparkSession, store: str, buckets: int | None = None) -> None:
    """Creates the headline and score tables of a store; leaves existing ones alone.

    Both are bucketed and sorted by `STORE_KEY`. ``buckets`` is the number of shuffle partitions unless given; it is kept in the store and
    can't change later. Choose it for the history's final size.
    """
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local_frame(spark, [(number,)], LAYOUT).coalesce(1).write.mode("ignore").parquet(f"{store}/layout")
    for name, schema in (("headlines", HEADLINES), ("scores", SCORES)):
        # an empty folder: a file without rows would be in no bucket
        local_frame(spark, [], schema).write.mode("ignore").partitionBy(STORE_KEY).parquet(f"{store}/{name}")


def _buckets_of(spark: SparkSession, path: str) -> int | None:
    """Buckets of a table of a store, None for a folder of other files."""
    store = path.rstrip("/").rpartition("/")[0]
    if store not in _buckets:
        try:
            _buckets[store] = spark.read.schema(LAYOUT).parquet(f"{store}/layout").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
    return _buckets[store]


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> str | None:
    """Name of a stored table in the session's catalog, where its path is entered when it's first used."""
    buckets = _buckets_of(spark, path)
    if buckets is None:
        return None
    name = f"tidewire_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({STORE_KEY}) SORTED BY ({STORE_KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    name = _stored(spark, path, schema)
    if name is None:
        return spark.read.schema(schema).parquet(path)
    spark.catalog.refreshTable(name)  # others may have appended
    return spark.table(name)


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """Stored headlines; a path without a table is an error (see `create_store`)."""
    return _read(spark, path, HEADLINES)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Stored scores; selecting ``headline_id`` alone reads that one column."""
    return _read(spark, path, SCORES)


def _append(rows: DataFrame, path: str, schema: T.StructType, counts: dict[str, Column]) -> dict[str, int]:
    """Appends in one job, one file a bucket. The counts are observed on the rows as they are written."""
    spark, name, counted = rows.sparkSession, _stored(rows.sparkSession, path, schema), Observation()
    rows = rows.select([F.col(field.name).cast(field.dataType) for field in schema])
    if name is not None:
        rows = rows.repartition(_buckets_of(spark, path), STORE_KEY)
    rows = rows.observe(counted, *[count.alias(label) for label, count in counts.items()])
    if name is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.insertInto(name)
    return counted.get


def append_headlines(new: DataFrame, path: str) -> int:
    """Appends rows that ``insert_if_absent`` let through; returns how many."""
    return _append(new, path, HEADLINES, {"rows": F.count(F.lit(1))})["rows"]


def append_scores(new: DataFrame, path: str) -> int:
    return _append(new, path, SCORES, {"rows": F.count(F.lit(1))})["rows"]


def save_bucketed(table: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Saves a table bucketed and sorted by a key, so that later joins on it need no shuffle."""
    writer = table.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def _since(width: int) -> Column:
    """First day of the folder that a date is in, where ``width`` days share one."""
    day = F.unix_date("date")
    return F.col("date") if width == 1 else F.date_from_unix_date(day - F.pmod(day, F.lit(width)))


def _width(spark: SparkSession, path: str) -> int:
    """Days that share a folder of the table of partials at a path. It only grows."""
    try:
        return spark.read.schema(WIDTH).parquet(f"{path}-width").agg(F.max("days").alias("days")).first()["days"] or 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 1


def _width_for(days: DataFrame, least: int) -> int:
    """The least width, ``least`` or above, with which some days have at most `MOST_FOLDERS` folders."""
    widths = [width for width in WIDTHS if width >= least]
    counts = days.agg(*[F.count_distinct(_since(width)).alias(str(width)) for width in widths]).first()
    return next((width for width in widths if counts[str(width)] <= MOST_FOLDERS), widths[-1])


def _partials(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Stored partials, with the folder that they are in as ``since``, by which they can be pruned."""
    if width == 1:
        return spark.read.schema(PARTIALS).parquet(path).withColumn("since", F.col("date"))
    return spark.read.schema(T.StructType([*PARTIALS, T.StructField("since", T.DateType())])).parquet(f"{path}-{width}")


def read_daily_partials(spark: SparkSession, path: str) -> DataFrame:
    """Stored partials, one row per ticker and day, in a folder for each day, or for as many days as `MOST_FOLDERS` asks for."""
    return _partials(spark, path, _width(spark, path)).drop("since")


def _by_day(partials: DataFrame, path: str, width: int, mode: str) -> None:
    """Replaces the folders of the partials' days (``dynamic``) or all (``static``), one file each."""
    spark, since = partials.sparkSession, "date" if width == 1 else "since"
    rows = partials.select(*PARTIALS.names, *([] if width == 1 else [_since(width).alias("since")]))
    # the rows are few, so that AQE would have one task write all files
    tasks = min(rows.select(since).distinct().count(), int(spark.conf.get("spark.sql.shuffle.partitions"))) or 1
    rows.repartition(tasks, since).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(since).parquet(
        path if width == 1 else f"{path}-{width}")


def _widen(partials: DataFrame, path: str, width: int) -> None:
    """Stores all partials with a greater width. The table of the old width stands until the new one is complete."""
    _by_day(partials, path, width, "static")
    local_frame(partials.sparkSession, [(width,)], WIDTH).coalesce(1).write.mode("append").parquet(f"{path}-width")


def add_daily_partials(new: DataFrame, path: str, batch: int | None = None) -> None:
    """Adds partials (`daily_partials`) to the stored ones of the same days, and rewrites the folders of those days only.

    A folder has one day until there are more than `MOST_FOLDERS`; then all are written again with more days each. With a ``batch`` number, which must
    grow, a day remembers the last batch that it took in: a batch that runs again adds only to days it had not reached. One writer at a time.
    """
    spark = new.sparkSession
    local_frame(spark, [], PARTIALS).write.mode("ignore").partitionBy("date").parquet(path)
    local_frame(spark, [], WIDTH).write.mode("ignore").parquet(f"{path}-width")
    new = materialize(new.withColumn("applied", F.lit(batch).cast("long")), "new-partials")
    width = wide = _width(spark, path)
    stored = touched = _partials(spark, path, width)
    asked = new.select(_since(width).alias("since")).distinct()
    if len(stored.inputFiles()) + asked.count() > MOST_FOLDERS:
        wide = _width_for(stored.select("date").unionByName(new.select("date")), width)
    if wide == width:
        touched = stored.where(F.col("since").isin([row["since"] for row in asked.collect()]))  # no more than there may be folders
    touched = touched.drop("since")
    if batch is not None:
        # A DATE column has at most 3.7 million values.
        done = touched.groupBy("date").agg(F.max("applied").alias("applied")).where(F.col("applied") >= batch).select("date")
        new = new.join(F.broadcast(done), "date", "left_anti")
    merged = touched.unionByName(new).groupBy("date", "ticker").agg(
        *[(F.max if name == "applied" else F.sum)(name).alias(name) for name in PARTIALS.names if name not in ("date", "ticker")]
    )
    merged = materialize(merged, "merged-partials")  # a folder can't be read and replaced in one job
    if wide == width:
        _by_day(merged, path, width, "dynamic")
    else:
        _widen(merged, path, wide)


def replace_daily_partials(partials: DataFrame, path: str) -> None:
    """Stores partials of all rows in place of whatever is there."""
    partials = materialize(partials.withColumn("applied", F.lit(None).cast("long")), "all-partials")
    width = _width(partials.sparkSession, path)
    wide = _width_for(partials.select("date"), width)
    if wide == width:
        _by_day(partials, path, width, "static")
    else:
        _widen(partials, path, wide)


def write_results(folder: str, **tables: DataFrame) -> None:
    """Result tables (daily, equity, metrics) as parquet in a new folder: the data behind the charts."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
