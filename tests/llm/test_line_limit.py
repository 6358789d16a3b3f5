"""The limit on lines acts on hosts of any size."""

import brute

from tidewire.llm import quality


def test_boilerplate_of_a_large_host(spark):
    own = [(i, "big", " ".join(f"own{i}x{k}" for k in range(60))) for i in range(3_000)]
    notice = " ".join(f"notice{k}" for k in range(70))
    depleted = [(10_000 + i, "big", f"{notice}\nshort text {i}") for i in range(40)]
    partly = [(20_000 + i, "big", notice + "\n" + " ".join(f"much{i}y{k}" for k in range(70))) for i in range(5)]
    rare = [(30_000 + i, "small", f"{notice}\nanother {i}") for i in range(19)]  # one text too few
    rows = own + depleted + partly + rare
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(frame).collect()}
    assert {i for i, (failed, kept) in got.items() if kept == failed} == {i for i, _, _ in depleted}  # kept is more than the base rules
    assert got == {i: x[5:] for i, x in brute.quality(rows).items()}


def test_lines_go_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = quality.line_table(docs)
    assert quality.frequent_lines(lines).count() >= 30
    assert quality.depleted_texts(docs).count() >= 1
