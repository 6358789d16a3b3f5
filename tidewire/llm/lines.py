"""Line dedup with levelled sorted runs of line hashes.

Documents are taken in batches, largest doc_ids first. The store is a list of *runs*: tables of
``line hash, documents, largest doc_id``, bucketed and sorted by the hash, so that a join with a run moves
and sorts only the batch. A batch anti-joins the runs: lines they don't hold are new, and the largest doc_id
of the batch is their holder; all other lines of the batch are repeats. Then the batch adds its own run.
When a level has ``fan_out`` runs, they are merged into one of the next level, so that a store of n
batches has O(log n) runs, and a hash is rewritten O(log n) times. In the end, the repeats whose hash is in enough
documents are dropped.

A hash has 128 bits. A line that a third of all documents hold is one row per task after the partial
aggregate, and the joins with runs are by hash, which AQE splits if skewed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, materialize
from .quality import let

KEY = ["h1", "h2"]


def _line_keys(min_chars: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "hash", "pos", "first", "h1", "h2")}
            for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash", "text"))):
                seen = set()
                for pos, line in enumerate((text or "").encode().split(b"\n")):
                    key = line.strip().lower()
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(key)
                    out["doc_id"].append(doc_id)
                    out["hash"].append(text_hash)
                    out["pos"].append(pos)
                    out["first"].append(digest not in seen)
                    out["h1"].append(int.from_bytes(digest[:8], "big", signed=True))
                    out["h2"].append(int.from_bytes(digest[8:], "big", signed=True))
                    seen.add(digest)
            kinds = {"pos": pa.int32(), "first": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    return keyed


class Runs:
    """The levelled store of one job, in the shared folder."""

    def __init__(self, spark: SparkSession, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = run.select(*KEY, "n", "top").repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", fresh_dir(self.spark, "run")).saveAsTable(name)
        stored = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only; the files stay for as long as the result is read
        return stored

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        all_runs = runs[0]
        for run in runs[1:]:
            all_runs = all_runs.union(run)
        return all_runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of lines; returns its repeats (``doc_id, hash, pos, h1, h2``)."""
        counted = materialize(lines.groupBy(*KEY).agg(F.sum(F.col("first").cast("long")).alias("n"), F.max("doc_id").alias("top")), "batch")
        new = counted
        for run in self.runs():
            new = new.join(run.select(*KEY), KEY, "left_anti")
        holders = new.select(*KEY, "top", F.lit(True).alias("new"))
        repeats = lines.join(holders, KEY, "left").where("new is null or not (doc_id <=> top)").select("doc_id", "hash", "pos", *KEY)
        repeats = materialize(repeats, "repeats")
        level, run = 0, self._write(counted)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_out:
                return repeats
            run = self._write(self.merged(self.levels[level]))
            self.levels[level] = []
            level += 1


def repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """``doc_id, hash, dropped``: positions (from 0) of the lines that a row of ``docs`` loses, if any."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"), F.col("text").cast("string").alias("text"))
    lines = texts.mapInArrow(_line_keys(min_chars), "doc_id long, hash long, pos int, first boolean, h1 long, h2 long")
    lines = materialize(lines, "lines")
    share = [k / batches for k in range(1, batches)]
    bounds = sorted(set(lines.agg(F.percentile_approx("doc_id", share, 1000)).first()[0] or []), reverse=True)
    store, found, above = Runs(spark), [], None
    for low in [*bounds, None]:
        part = lines if above is None else lines.where((F.col("doc_id") < above) | F.col("doc_id").isNull())
        found.append(store.add(part if low is None else part.where(F.col("doc_id") >= low)))
        above = low
    often = store.merged(store.runs()).where(F.col("n") >= min_docs).select(*KEY)
    repeats = found[0]
    for more in found[1:]:
        repeats = repeats.union(more)
    return repeats.join(often, KEY).groupBy("doc_id", "hash").agg(F.collect_set("pos").alias("dropped"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, dropped in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist()):
            lines = (text or "").split("\n")
            gone = set(dropped or ())
            counts.append((len(lines), len(gone)))
            texts.append("\n".join(line for at, line in enumerate(lines) if at not in gone) if gone else text)
        shas = [hashlib.sha256((text or "").encode()).hexdigest() for text in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("hash"), pa.array([n for n, _ in counts], pa.int64()), pa.array([n for _, n in counts], pa.int64()),
             pa.array(texts, pa.string()), pa.array(shas, pa.string())],
            ["doc_id", "hash", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def deduped_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """``doc_id, hash, n_lines, n_dropped, kept_text, kept_sha256`` for every row of ``docs`` (doc_id, text).

    A key is a line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` rows hold lose all their lines, except in the rows with the
    largest of their doc_ids. Null and empty texts are one empty line (and stay as they are). Rows
    that repeat a doc_id count each; if it's the largest, each of them keeps the line. A null doc_id is
    less than all others. Other columns are ignored.
    """
    dropped = repeated_lines(docs, min_docs, min_chars, batches).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "dropped")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"), F.col("text").cast("string").alias("text"))
    joined = texts.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "hash", "text", "dropped").mapInArrow(
        _cut, "doc_id long, hash long, n_lines long, n_dropped long, kept_text string, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4) -> DataFrame:
    """``docs`` with the texts that `deduped_lines` leaves; rows and other columns stay, also where nothing is left."""
    dropped = repeated_lines(docs, min_docs, min_chars, batches).toDF("cut_id", "cut_hash", "dropped")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("hash") == F.col("cut_hash")), "left")
    kept = let(F.split(F.coalesce("row.text", F.lit("")), "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")), lambda at: F.get(lines, at)), "\n"))
    new = F.when(F.col("dropped").isNull(), F.col("row.text").cast("string")).otherwise(kept).alias("text")
    return joined.select(*[new if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
