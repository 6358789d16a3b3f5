"""Token counts of documents without their ids.

1. Each document is cut into pre-tokens by the tokenizer's own rule, and their frequencies are kept,
   dictionary-encoded by block (`frequencies`).
2. The distinct pre-tokens of all blocks meet by a shuffle on the pre-token, and the model is run
   once for each distinct one.
3. Its number of pieces goes back to the blocks that hold it, where it is joined to the documents' frequencies
   and summed. Only counts move: a list of ids is never made for a document.

A pre-token of a third of all documents is one row per block. Blocks are bounded, and so is what a task holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .frequencies import BLOCK_BYTES, Block, pack, unpack

#: The published pattern of byte-level pre-tokenizers (a fixed value).
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class is the same in the libraries' versions of Unicode; texts with others are cut by the tokenizer itself.
UNSURE = re.compile("[^\0-՗Ḁ-ỿ‐-‧ぁ-ゖァ-ヺ一-鿿가-힣]")


#: Rows that a task gathers before it packs them by block.
OUT_ROWS = 200_000


class Counting:
    """Cuts texts into pre-tokens and counts the pieces of a pre-token, for a byte-level tokenizer."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.regular = "use_regex=True" in str(self.tokenizer.pre_tokenizer) and "add_prefix_space=False" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens; strings of added tokens are pieces of their own, as in the library's default."""
        if self.split_special and any(s in text for s in self.special):
            return [p for at, part in enumerate(self.split_special.split(text)) for p in ([part] if at % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return BYTE_LEVEL.findall(text)

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]


_COUNTING: dict[str, Counting] = {}


def _counting(spec) -> Counting:
    """The worker's tokenizer; tasks with another one replace it."""
    if spec.value not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[spec.value] = Counting(spec.value)
    return _COUNTING[spec.value]


def _blocks(spec, block_bytes: int):
    names = ["block", "doc_id", "n_bytes", "codes", "counts", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, task = _counting(spec), TaskContext.get().partitionId() << 32
        block, rows = Block(), []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n_bytes = len(text.encode()) if text else 0
                tokens = Counter(counting.pre_tokens(text)) if text else Counter()
                rows.append((task, doc_id, n_bytes, *pack(*block.add(tokens, n_bytes)), None))
                if block.bytes >= block_bytes:
                    rows.append((task, None, None, None, None, list(block.codes)))
                    yield out()
                    block, rows, task = Block(), [], task + 1
            if len(rows) > 2_000:
                yield out()
                rows = []
        rows.append((task, None, None, None, None, list(block.codes)))
        yield out()

    return run


def _packed_by_block(blocks: np.ndarray, codes: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """One row per block with the numbers of its tokens and their pieces."""
    order = np.argsort(blocks, kind="stable")
    blocks, codes, pieces = blocks[order], codes[order], pieces[order]
    edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1, append=blocks[-1:] + 1))
    rows = [(int(blocks[a]), *pack(codes[a:b], pieces[a:b])) for a, b in zip(edges, edges[1:])]
    kinds = [pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, kinds)], ["block", "codes", "pieces"])


def _count_once(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, last, pieces = _counting(spec), None, 0
        held, n = [], 0
        for batch in batches:  # sorted by token
            if not batch.num_rows:
                continue
            tokens = batch.column("token").dictionary_encode()
            distinct = tokens.dictionary.to_pylist()
            start = int(distinct[0] == last)
            found = np.array([pieces] * start + counting.pieces(distinct[start:]), np.int64)
            last, pieces = distinct[-1], int(found[-1])
            held.append((batch.column("block").to_numpy(), batch.column("code").to_numpy(), found[tokens.indices.to_numpy()]))
            n += batch.num_rows
            if n >= OUT_ROWS:
                yield _packed_by_block(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield _packed_by_block(*map(np.concatenate, zip(*held)))

    return run


def _sum(docs: pa.Table, counted: pa.Table) -> pa.Table:
    parts = [unpack(c, p) for c, p in zip(counted.column("codes").to_pylist(), counted.column("pieces").to_pylist())]
    pieces = np.zeros(sum(len(at) for at, _ in parts), np.int64)  # every number of the block once
    for at, n in parts:
        pieces[at] = n
    totals = []
    for codes, counts in zip(docs.column("codes").to_pylist(), docs.column("counts").to_pylist()):
        at, n = unpack(codes, counts)
        totals.append(int(pieces[at] @ n) if len(at) else 0)
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64())})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs`` (doc_id, text).

    ``tokenizer`` is a file of the tokenizers library with a byte-level BPE model, read by the driver and broadcast.
    Tokens are those of the library without begin or end; strings of added tokens inside a text are
    those tokens. Null texts are empty; empty texts have no tokens. Other columns are ignored, repeated rows counted each.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec_text = file.read()
    if not Counting(spec_text).regular:
        raise ValueError("not a byte-level tokenizer with the published pattern and without a normalizer")
    spec = docs.sparkSession.sparkContext.broadcast(spec_text)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = materialize(texts.mapInArrow(
        _blocks(spec, block_bytes), "block long, doc_id long, n_bytes long, codes binary, counts binary, tokens array<string>"), "frequencies")
    tokens = held.where("tokens is not null").select("block", F.posexplode("tokens").alias("code", "token"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = tokens.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_count_once(spec), "block long, codes binary, pieces binary")
    rows = held.where("tokens is null").select("block", "doc_id", "n_bytes", "codes", "counts")
    summed = rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return summed.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
