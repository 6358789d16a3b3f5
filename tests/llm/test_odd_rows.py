"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for all operators and stages."""

import public_tokenizers
import pytest

import corpus_pipeline
from tidewire.llm import chunks, decontaminate, lines, lm, minhash, quality, sentencepiece_codec, sharding, token_counts, url_filter

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def bench(spark):
    return spark.createDataFrame([(0, "one two"), (1, None), (2, ""), (None, "no id but a text no id")], "item_id long, text string")


OPERATORS = {
    "encode": lambda s, d: sentencepiece_codec.encode(d, PIECES),
    "token_counts": lambda s, d: token_counts.token_counts(d, BPE),
    "near_groups": lambda s, d: minhash.near_groups(d, 3, 85),
    "passages": lambda s, d: chunks.repeated_passages(d),
    "lines": lambda s, d: lines.deduped_lines(d),
    "shards": lambda s, d: sharding.uniform_shards(d, 3),
    "quality": lambda s, d: quality.quality_rules(d),
    "lm": lambda s, d: lm.lm_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_per_row(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


def test_leaks_of_odd_rows(spark, odd):
    found = decontaminate.contaminated(odd, bench(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["item_id"]) for r in found) == [(False, 9, 0), (False, 10, 0), (True, None, None)]
    assert decontaminate.contaminated(odd.limit(0), bench(spark)).count() == 0
    assert decontaminate.contaminated(odd, bench(spark).limit(0)).count() == 0


def test_ties_of_near_groups(spark, odd):
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_groups(odd, 3, 85).collect() if r["doc_id"] is not None)
    assert [x for x in got if x[0] in (9, 10)] == [(9, 9, 1), (10, 9, 1)]
    assert [x for x in got if x[0] in (1, 2, 3, 7)] == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (7, 7, 0)]
    kept = minhash.drop_near_duplicates(odd, 3, 85)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 11] and ids.count(None) == 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, tmp_path, name, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    result = stage(spark, odd, str(tmp_path))
    empty = stage(spark, odd.limit(0), str(tmp_path))
    if name != "sentencepiece":
        assert result.columns == odd.columns and empty.columns == odd.columns
    assert result.count() <= odd.count() and empty.count() == 0


def test_urls(spark):
    rows = [(1, None, None), (2, "", "<link"), (None, "x://H", None), (3, "no scheme", "<link rel=canonical href=/a>"), (3, "a://b.com/en/", ""), (3, "a://b.com/en/", "")]
    pages = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "page_id long, url string, html string, host string, rule string, node string")
    rules = [("block", "b.com", "/en/"), ("allow", "com", "/")]
    got = url_filter.filter_urls(pages, rules).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted([
        ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("None", "h", "", None, "allow"), ("3", "", "", None, "allow"),
        ("3", "b.com", "/en/", "b.com/en/", "block"), ("3", "b.com", "/en/", "b.com/en/", "block")], key=str)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
