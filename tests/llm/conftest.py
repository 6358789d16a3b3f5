import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from paths import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def doc_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


CLASHES = ["hash", "class", "_id", "_hash", "_key", "_texthash", "block", "row", "n", "keys", "u", "v", "shard", "slot", "_part", "number",
           "words", "codes", "text_id", "least", "spans", "dropped", "kept", "rule", "node", "component_id", "_dropped", "_host"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null and repeated ids, repeated rows, blanks, a very long text, columns with names that operators use."""
    long = " ".join(f"word{i % 7919} filler{i % 13}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (None, "no id but a text " * 30, "b"), (None, None, None), (4, long, "a"),
            (5, "Same row twice, " + "é" * 30, "b"), (5, "Same row twice, " + "é" * 30, "b"), (5, "the id again, another text", "b"),
            (6, "<|endoftext|> inside", "c"), (7, "\n\n\n", "c"), (8, "x", "c"), (9, "One Two", "c"), (10, "one two", "c"), (11, "日本語のテキスト" * 20, "c")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, s, "en", 0, *["clash"] * len(CLASHES)) for i, t, s in rows], schema)
