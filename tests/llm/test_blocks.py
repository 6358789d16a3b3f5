"""The language model's blocks: words as plain Python finds them, and little that a worker keeps."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import lm
from tidewire.llm.frequencies import unpack
from tidewire.llm.words import words_of

TEXTS = [None, "", " ", "\n\n", "a", " A a\tb\x0b\x0cc\r\n", "\x00 é É \x1f\x85\xa0x ", "日本 語 日本", "<s> \x1c one  One", "end\n", "x" * 5_000 + " y"]


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))

    def run(texts, block_bytes):
        batches = [pa.record_batch({"doc_id": pa.array(range(at, at + len(part)), pa.int64()), "text": pa.array(part, pa.string())})
                   for at in range(0, len(texts), 4) for part in [texts[at : at + 4]]]
        return [r for b in lm._blocks(block_bytes)(iter(batches)) for r in b.to_pylist()]

    return run


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 20])
def test_blocks_hold_all_words_in_order(blocks, block_bytes):
    rows = blocks(TEXTS, block_bytes)
    words = {r["block"]: r for r in rows if r["words"] is not None}
    docs = [r for r in rows if r["words"] is None]
    assert [r["doc_id"] for r in docs] == [r["row"] for r in docs] == list(range(len(TEXTS)))
    assert len(words) == len({r["block"] for r in docs}) == {1: len(TEXTS), 300: len(words), 1 << 20: 1}[block_bytes]
    trained = dict.fromkeys(words, 0)
    for r, text in zip(docs, TEXTS):
        want, held = [*words_of(text), lm.END], words[r["block"]]
        codes, counts = unpack(r["codes"], r["counts"])
        code_of = dict(zip(held["words"], held["ids"]))
        assert r["n_tokens"] == len(want) and r["held_out"] == lm.is_held_out(r["doc_id"])
        assert {held["words"][c]: n for c, n in zip(codes, counts)} == {w: want.count(w) for w in want}
        assert lm.unpacked(r["sequence"]).tolist() == [code_of[w] for w in want]
        trained[r["block"]] += 0 if r["held_out"] else len(want)
    assert all(sum(held["train"]) == trained[block] for block, held in words.items())
    assert len({(w, i) for held in words.values() for w, i in zip(held["words"], held["ids"])}) == len({w for held in words.values() for w in held["words"]})


def test_workers_keep_no_words(blocks):
    rows = blocks([f"word{i}ing" for i in range(30_000)], 1 << 20)
    assert len({w for r in rows for w in r["words"] or ()}) == 30_001
    kept = [x for x in vars(lm).values() if isinstance(x, dict) and type(x) is not type(vars(lm)["__builtins__"])]
    assert sum(map(len, kept)) < 1_000


def test_many_small_documents_are_several_blocks(blocks):
    assert len({r["block"] for r in blocks([""] * 4_000, 100_000)}) > 1 and np.all(np.diff([r["row"] for r in blocks([""] * 50, 1_000) if r["words"] is None]) == 1)
