"""Registered queries over the smallest tables: against their SQL where there is one, else by count and type."""

import duckdb
import pytest
from paths import SMALL

import __spark_entry__ as entry_points
from tidewire.llm import queries
from tidewire.llm.oracle import oracle_sql

COLUMNS = {
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                         "base_failed boolean, kept boolean",
    "op10_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op12_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


def test_all_are_registered():
    found = entry_points.queries()
    assert {int(name[2:].split("_")[0]) for name in found if name.startswith("op")} == set(range(1, 14)) and "pipeline" in found
    assert set(queries.queries()) <= set(found) and set(oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    frame = queries.queries()[name](spark, SMALL)
    assert ", ".join(f"{c} {t}" for c, t in frame.dtypes) == COLUMNS[name]
    assert frame.count() == spark.read.parquet(f"{SMALL}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, duck, name):
    frame = queries.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(tuple(str(row[c]) for c in columns) for row in frame.collect())
    cursor = duck.execute(f"select {', '.join(columns)} from ({oracle_sql()[name]})")
    assert got == sorted(tuple(map(str, row)) for row in cursor.fetchall())
