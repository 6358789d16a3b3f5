"""Incremental ingest and scoring: landed files are picked up once, the store is appended to.

Two streams follow each other. The first, without state, parses landed files; each of its batches is written to a folder with one row per key,
the first in arrival order. The second keeps every key in Spark's state store (RocksDB), without a time bound, and lets the rows of new
keys through. A batch so looks up its own keys only, and the stored headlines aren't read for it. What others store, or a lost checkpoint knew,
reaches the state from the store's new files, which the second stream reads beside the parsed rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import ARRIVAL, first_of_key, insert_if_absent
from ..operators.normalize import normalize_news, normalize_posts
from ..operators.scoring import score, score_pending
from ..schemas import HEADLINES
from ..session import local_frame, materialize
from ..sources.landed import arrival, parse_listing, parse_news
from ..sources.tables import STORE_KEY, append_headlines, append_scores, create_store, read_headlines, read_scores

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def score_leftovers(spark: SparkSession, store: str, score_backend: str, **score_options) -> int:
    """Scores all stored headlines without a score, such as those of a run that was cut short; returns how many."""
    pending = score_pending(
        read_headlines(spark, f"{store}/headlines"), read_scores(spark, f"{store}/scores"), score_backend, **score_options
    )
    return append_scores(pending, f"{store}/scores")


def store_new(new: DataFrame, store: str, score_backend: str | None = None, **score_options) -> tuple[int, int]:
    """Appends headlines that are known to be new, and scores them; returns both counts."""
    inserted = append_headlines(new, f"{store}/headlines")
    if score_backend is None:
        return inserted, 0
    scores = score(new.select("headline_id", "ticker", "title"), score_backend, **score_options)
    return inserted, append_scores(scores, f"{store}/scores")


def ingest_batch(rows: DataFrame, store: str, score_backend: str | None = None, **score_options) -> tuple[int, int]:
    """Stores the new ones of some headline rows, and scores them; returns both counts.

    Running it again on the same rows stores nothing. The stored ids are read in place, since the store is bucketed by them. Only
    the batch's own new rows are scored (`score_leftovers` is for older ones). The store must exist.
    """
    new = insert_if_absent(rows, read_headlines(rows.sparkSession, f"{store}/headlines"), (STORE_KEY,))
    return store_new(materialize(new, "new-headlines"), store, score_backend, **score_options)


def _parsed_files(
    spark: SparkSession, source: str, checkpoint: str, as_of: Column, kind: str, watch: str | Iterable[str] | None, files_per_batch: int
) -> None:
    """Writes the headline rows of files not seen before below ``checkpoint/parsed``, one row per key and batch."""
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
        .select("value", "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_block_start")
    )

    def parse(batch: DataFrame, batch_id: int) -> None:
        # Files of a batch are taken in the order they were written; in a batch frame the lines
        # of a block can be numbered.
        file = F.concat_ws("|", F.date_format("file_modification_time", "yyyyMMddHHmmss.SSS"), "file_path")
        seq = arrival(file, F.col("file_block_start"), F.monotonically_increasing_id())
        numbered = batch.select("value", seq.alias("seq"))
        if kind == "news":
            rows = normalize_news(parse_news(numbered), as_of, watch)
        else:
            rows = normalize_posts(parse_listing(numbered), watch, as_of)
        first = first_of_key(rows, (STORE_KEY,), ARRIVAL).select(*HEADLINES.names).withColumn("batch", F.lit(batch_id).cast("long"))
        first.write.mode("overwrite").parquet(f"{checkpoint}/parsed/{batch_id}")

    lines.writeStream.foreachBatch(parse).option("checkpointLocation", f"{checkpoint}/files").trigger(availableNow=True).start().awaitTermination()


def _begun_before(spark: SparkSession, marker: str) -> bool:
    """Whether a marker is there; leaves one."""
    try:
        spark.read.schema("begun boolean").parquet(marker)
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    local_frame(spark, [(True,)], "begun boolean").coalesce(1).write.mode("ignore").parquet(marker)
    return False


def new_keys(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a stream (headline columns, batch) whose key neither ``stored``, a stream of ids, nor an earlier row had; in update mode.

    The state of a key is its first row and the time of the batch that brought it. All batches of a key are folded before the shuffle.
    """
    payload = F.struct(*[F.col(name) for name in HEADLINES.names if name != STORE_KEY], "batch")
    known = stored.select(STORE_KEY, F.lit(None).cast(parsed.select(payload.alias("first")).schema["first"].dataType).alias("first"))
    both = parsed.select(STORE_KEY, payload.alias("first"), F.lit(False).alias("stored")).unionByName(known.withColumn("stored", F.lit(True)))
    # In a stream, the current time is the time of the batch, also if the batch runs again.
    seen = both.withColumn("now", F.current_timestamp()).groupBy(STORE_KEY).agg(
        F.min_by("first", "first.batch").alias("first"), F.bool_or("stored").alias("stored"), F.min("now").alias("since")
    )
    return seen.where((F.col("since") == F.current_timestamp()) & ~F.col("stored")).select(STORE_KEY, "first.*").select(*HEADLINES.names)


def ingest_stream(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    as_of: Column,
    kind: str = "news",
    watch: str | Iterable[str] | None = None,
    score_backend: str | None = None,
    files_per_batch: int = 1000,
    **score_options,
) -> StreamingQuery:
    """Ingests the files of a folder that were not seen before, then stops; run it again for more.

    ``kind`` is ``news`` or ``forum`` (which needs a watchlist). The checkpoint remembers the files and the keys; the store's files bring
    back the keys, so a lost checkpoint costs time, not rows. Only a batch that was begun before, and may have been stored without
    being noted, is compared with the store. One writer of a store at a time.
    """
    create_store(spark, store)
    if score_backend is not None:
        score_leftovers(spark, store, score_backend, **score_options)
    _parsed_files(spark, source, checkpoint, as_of, kind, watch, files_per_batch)

    columns = T.StructType([*HEADLINES.fields, T.StructField("batch", T.LongType())])
    # files go once they are in the state
    parsed = spark.readStream.schema(columns).option("recursiveFileLookup", True).option("cleanSource", "delete").parquet(f"{checkpoint}/parsed")
    stored = spark.readStream.schema(HEADLINES).parquet(f"{store}/headlines")

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        new = materialize(batch, "new-headlines")  # the state is asked once
        if _begun_before(spark, f"{checkpoint}/begun/{batch_id}"):
            stored_ids = read_headlines(spark, f"{store}/headlines").select(STORE_KEY)
            new = materialize(new.join(stored_ids, STORE_KEY, "left_anti"), "new-headlines")
        store_new(new, store, score_backend, **score_options)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # read when the query starts
    try:
        return (
            new_keys(parsed, stored).writeStream.outputMode("update").foreachBatch(store_batch)
            .option("checkpointLocation", f"{checkpoint}/keys")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
