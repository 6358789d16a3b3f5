"""One query per operator, over whole tables, with the parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file that lies beside the installed libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_sentencepiece(spark, sf_dir):
    from .sentencepiece_codec import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@_query
def op3_minhash_dedup(spark, sf_dir):
    from .minhash import near_groups

    groups = near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)
    return groups.selectExpr("doc_id", "n_shingles", "component_id", "doc_id <=> component_id as kept")


@_query
def op5_line_dedup(spark, sf_dir):
    from .lines import deduped_lines

    return deduped_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@_query
def op6_decontaminate(spark, sf_dir):
    from .decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "item_id", "start as start_word", "words as n_words", "round(similarity, 6) as similarity")


@_query
def op9_quality_rules(spark, sf_dir):
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("host", "hash")


@_query
def op2_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@_query
def op7_sharding(spark, sf_dir):
    from pyspark.sql import functions as F

    from .sharding import uniform_shards

    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return uniform_shards(rows, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@_query
def op8_url_filter(spark, sf_dir):
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), RULES)


@_query
def op10_lm_scoring(spark, sf_dir):
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


@_query
def op4_substring_dedup(spark, sf_dir):
    from .chunks import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@_query
def op11_exact_dedup(spark, sf_dir):
    from .exact import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.selectExpr("doc_id", "keep_id", "group_size", "doc_id <=> keep_id as kept", "lower(hex(digest)) as text_sha256")


@_query
def op12_token_alignment(spark, sf_dir):
    from .alignment import alignment_statistics

    return alignment_statistics(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@_query
def op13_lexical_search(spark, sf_dir):
    from .search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
