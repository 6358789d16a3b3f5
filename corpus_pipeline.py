"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again.

1. quality rules: documents that they reject go;
2. line dedup: lines that three documents hold stay in the one with the largest doc_id;
3. near duplicates: of each group (five-word shingles, similarity 0.8) the smallest doc_id stays;
4. decontamination: documents that hold a benchmark item go;
5. SentencePiece: the ids of the remaining texts, and whether they decode to the text.

``ORACLE_SQL`` is None: neither signatures and windows nor a tokenizer can be put in SQL. The tests compare
each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.decontaminate import drop_contaminated
from tidewire.llm.lines import drop_repeated_lines
from tidewire.llm.minhash import drop_near_duplicates
from tidewire.llm.quality import keep_good
from tidewire.llm.queries import tokenizer_file
from tidewire.llm.sentencepiece_codec import encode
from tidewire.session import materialize

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: ``doc_id, n_pieces, ids, n_repaired, round_trip``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
