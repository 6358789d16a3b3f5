"""The shared folder of a run, and cutting lineage with tables written there."""

from __future__ import annotations

import logging
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

log = logging.getLogger(__name__)

#: Folders of local sessions that name none; removed at exit.
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Where it is unset, a local session gets one of its own, which goes when Python ends; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.TemporaryDirectory(prefix="tidewire-", ignore_cleanup_errors=True)
    return _LOCAL[application].name


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: computed once, safe from lost executors."""
    path = fresh_dir(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows held by the driver as a frame; by Arrow, so that the plan needs no Python workers."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = [[row[place] for row in rows] for place in range(len(schema))]
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema)), schema)
