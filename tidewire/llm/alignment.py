"""Alignment of the tokens of two tokenizers, by runs along a diagonal.

A text has tokens of A (byte-level BPE) and of B (SentencePiece); each list is the array of the byte offsets where its tokens end. Where both
arrays hold an offset, both cut the text; such offsets cut the tokens into groups. Mostly tokens go one to one: token i of A ends where
token i + shift of B ends, for the shift reached so far. `diagonal` therefore compares stretches of the two arrays at the current shift,
of 1, 2, 4, ... tokens while they are equal, and jumps over each; where the next stretch differs, it is halved to find the run's end. What
follows is an irregular group: the array that is behind moves on until both meet, which settles the shift for the next run.

How often an A id and a B id overlap is counted over all texts: a task numbers the id pairs of its block of texts (`frequencies`), pairs
meet by a shuffle, and their totals return to the blocks, as numbers only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .frequencies import BLOCK_BYTES, Block, pack, unpack
from .token_counts import BYTE_LEVEL, UNSURE

#: Bytes of an array element.
ITEM = 4
#: An id pair as one number: the A id above these bits, the B id below.
SHIFT = 24
#: Texts that A encodes by its own library: of characters with an uncertain class, or of white space so long that the other one can't cut it.
OWN_LIBRARY = re.compile(f"{UNSURE.pattern}|\\s{{1000}}")


class Groups(NamedTuple):
    """What `diagonal` finds."""

    runs: list[tuple[int, int, int]]  # one-to-one stretches: first token of A, of B, and how many
    links_a: list[int]  # overlapping tokens of irregular groups: of A ...
    links_b: list[int]  # ... and of B
    inner_a: list[int]  # tokens of A that don't end a group
    inner_b: list[int]  # tokens of B that don't


def diagonal(ends_a: np.ndarray, ends_b: np.ndarray) -> Groups:
    """Groups of two lists of tokens that end at ``ends_a`` and ``ends_b`` (int32, ascending, with the same last offset)."""
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    found = runs, links_a, links_b, inner_a, inner_b = Groups([], [], [], [], [])
    a, b, total = 0, 0, len(list_a)
    while a < total:
        if list_a[a] == list_b[b]:
            start, move, step = a, (b - a) * ITEM, 2  # the shift holds for the whole run
            a += 1
            low, high = a * ITEM, (a + 2) * ITEM
            while a + step <= total and raw_a[low:high] == raw_b[low + move : high + move]:
                a, step = a + step, 2 * step
                low, high = high, (a + step) * ITEM
            while step > 1:  # the run ends within the last stretch
                step //= 2
                high = low + step * ITEM
                if a + step <= total and raw_a[low:high] == raw_b[low + move : high + move]:
                    a, low = a + step, high
            runs.append((start, b, a - start))
            b += a - start
            if a == total:
                break
        end_a, end_b = list_a[a], list_b[b]
        while True:  # whichever is behind moves on; the two tokens at hand always overlap
            links_a.append(a)
            links_b.append(b)
            if end_a < end_b:
                inner_a.append(a)
                a += 1
                end_a = list_a[a]
            elif end_b < end_a:
                inner_b.append(b)
                b += 1
                end_b = list_b[b]
            else:
                break
        a, b = a + 1, b + 1
    return found


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Alignment:
    """The tokens of one text and their groups."""

    def __init__(self, pair: Pair, ids_a: np.ndarray, ids_b: np.ndarray):
        self.pair, self.ids_a, self.ids_b = pair, ids_a, ids_b
        self.ends_a = np.cumsum(pair.length_a[ids_a], dtype=np.int32)
        self.found = diagonal(self.ends_a, np.cumsum(pair.length_b[ids_b], dtype=np.int32))
        #: Whether a token is the last one of its group.
        self.last_a, self.last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        self.last_a[self.found.inner_a] = False
        self.last_b[self.found.inner_b] = False
        #: Numbers of tokens up to the end of each group.
        self.stops_a, self.stops_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1

    def links(self) -> np.ndarray:
        """The id pair of each A and B token that overlap, as one number."""
        runs = np.array(self.found.runs, np.int64).reshape(-1, 3)
        lengths = runs[:, 2]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at_a = np.concatenate([np.repeat(runs[:, 0], lengths) + within, np.array(self.found.links_a, np.int64)])
        at_b = np.concatenate([np.repeat(runs[:, 1], lengths) + within, np.array(self.found.links_b, np.int64)])
        return self.ids_a[at_a].astype(np.int64) << SHIFT | self.ids_b[at_b]

    def written(self) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        size_a, n_a, n_b = len(self.pair.length_a), len(self.ids_a), len(self.ids_b)
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        place = np.empty(n_a + n_b, np.int64)  # every token with the sign behind it, in its place
        place[np.arange(n_a) + np.concatenate([[0], self.stops_b])[group_a]] = self.ids_a + size_a * self.last_a
        place[np.arange(n_b) + self.stops_a[group_b]] = 2 * size_a + self.ids_b + len(self.pair.length_b) * self.last_b
        return self.pair.signs.take(place).tobytes().replace(b"\0", b"")[:-1]


class Pair:
    """Both tokenizers of a worker.

    A's vocabulary and merges, whose order must be that of their ids, also make an encoder of the tiktoken library, which gives the same ids
    several times faster; texts for which that isn't certain are encoded by the tokenizers library.
    """

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = Tokenizer.from_str(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        rules = json.loads(spec)
        vocab, alphabet = rules["model"]["vocab"], _byte_alphabet()
        merges = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in rules["model"]["merges"]]
        cut = str(self.a.pre_tokenizer)
        if self.a.normalizer is not None or "use_regex=True" not in cut or "add_prefix_space=False" not in cut or merges != sorted(merges):
            raise ValueError("not a byte-level tokenizer with the published pattern, ids in order of merges and without a normalizer")
        ranks = {bytes(map(alphabet.__getitem__, entry)): i for entry, i in vocab.items() if all(c in alphabet for c in entry)}
        if not all(bytes([b]) in ranks for b in range(256)):  # then A's tokens spell any text
            raise ValueError("the vocabulary lacks single bytes")
        self.fast = tiktoken.Encoding("A", pat_str=BYTE_LEVEL.pattern, mergeable_ranks=ranks, special_tokens={})
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.length_a = np.array([len(e) for e in entries], np.int32)  # a character for each byte
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int32)
        signs = [f"{i}{sign}" for size, sign in ((len(entries), ","), (len(entries), "|"), (len(pieces), ","), (len(pieces), ";")) for i in range(size)]
        self.signs = np.array(signs, bytes)  # of one width, filled up with zero bytes

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space+text by A, and of text by B, which puts the space in front itself."""
        spaced = " " + text
        own = OWN_LIBRARY.search(text)
        a = self.a.encode(spaced, add_special_tokens=False).ids if own else self.fast.encode_to_numpy(spaced, disallowed_special=())
        return np.asarray(a).astype(np.int32), np.array(self.b.encode(text), np.int32)

    def align(self, text: str | None) -> Alignment | None:
        """None where the text has no tokens, by the rule of `alignments`."""
        if not text:
            return None
        a, b = self.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            return None
        return Alignment(self, a, b)


_PAIRS: dict[tuple[str, int], Pair] = {}


def _pair(shared) -> Pair:
    """The worker's tokenizers; tasks with others replace them."""
    spec, model = shared.value
    key = (spec, hash(model))
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(spec, model)
    return _PAIRS[key]


def _read(docs: DataFrame, tokenizer: str, model: str):
    """Both vocabulary files (a few MB), broadcast, and the columns in use."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    with open(model, "rb") as file:
        data = file.read()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.sparkSession.sparkContext.broadcast((spec, data)), texts


def _grouped(found: list[Alignment | None]) -> pa.Array:
    """A list of groups (ids of A, ids of B, end) for each alignment."""
    some = [x for x in found if x is not None]

    def lists(ids: list[np.ndarray], stops: list[np.ndarray]) -> pa.Array:
        begins = accumulate(map(len, ids), initial=0)
        offsets = np.concatenate([[0], *[begin + stop for begin, stop in zip(begins, stops)]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    a_ids, b_ids = lists([x.ids_a for x in some], [x.stops_a for x in some]), lists([x.ids_b for x in some], [x.stops_b for x in some])
    ends = pa.array(np.concatenate([np.zeros(0, np.int32), *[x.ends_a[x.last_a] for x in some]]))
    groups = pa.StructArray.from_arrays([a_ids, b_ids, ends], ["a_ids", "b_ids", "end"])
    sizes = [0 if x is None else len(x.stops_a) for x in found]
    return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), groups)


def alignments(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``doc_id, groups`` of each row of ``docs`` (doc_id, text): the ids of both tokenizers between two common cuts, and the byte offset
    in space+text where they end.

    A is a byte-level BPE file of the tokenizers library and encodes space+text, B a SentencePiece model that puts a space in front itself;
    both without special tokens, whose strings in texts are plain text. Null and empty texts have no groups, nor have texts whose A or B tokens don't spell
    space+text (as with U+2581 in the text). Repeated rows and null doc_ids are rows like others; other columns are ignored.
    Nothing is shuffled; a text is held whole by one task.
    """
    shared, texts = _read(docs, tokenizer, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                found = [pair.align(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _grouped(found)], ["doc_id", "groups"])

    return texts.mapInArrow(run, "doc_id long, groups array<struct<a_ids:array<int>,b_ids:array<int>,end:int>>")


def _blocks(shared, block_bytes: int):
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts", "pairs", "totals"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair(shared), TaskContext.get().partitionId() << 32
        block, totals, rows = Block(), np.zeros(1 << 16, np.int64), []

        def closing() -> tuple:
            return (number, *[None] * 8, list(block.codes), totals[: len(block.codes)])

        for doc_id, text in ((i, t) for x in batches for i, t in zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist())):
            aligned = pair.align(text)
            if aligned is None:
                rows.append((number, doc_id, 0, 0, 0, 0, "", b"", b"", None, None))
            else:
                links = aligned.links()
                distinct, times = np.unique(links, return_counts=True)
                codes, times = block.add(dict(zip(distinct.tolist(), times.tolist())), len(text))
                if len(block.codes) > len(totals):
                    totals = np.concatenate([totals, np.zeros(len(block.codes), np.int64)])
                totals[codes] += times
                sizes = len(aligned.ids_a), len(aligned.ids_b), len(aligned.stops_a), len(links)
                rows.append((number, doc_id, *sizes, hashlib.sha256(aligned.written()).hexdigest(), *pack(codes, times), None, None))
            if block.bytes >= block_bytes:
                yield out([*rows, closing()])
                block, totals, rows, number = Block(), np.zeros(1 << 16, np.int64), [], number + 1
            elif len(rows) > 2_000:
                yield out(rows)
                rows = []
        yield out([*rows, closing()])

    return run


def _pack_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block, code and value, one row per block and batch: the codes with their values, in bytes."""
    for batch in batches:
        blocks, codes, values = (batch.column(c).to_numpy() for c in ("block", "code", "value"))
        order = np.argsort(blocks, kind="stable")
        blocks, codes, values = blocks[order], codes[order].astype(np.int32), values[order]
        edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1, append=blocks[-1:] + 1)) if len(blocks) else []
        rows = [(int(blocks[x]), codes[x:y].tobytes(), values[x:y].tobytes()) for x, y in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["block", "codes", "values"])


STATISTICS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Sums, for the documents of a block, the totals of their id pairs; a value is twice the total, and one more where it's the highest."""
    codes = np.concatenate([np.frombuffer(x, np.int32) for x in known.column("codes").to_pylist()] or [np.zeros(0, np.int32)])
    values = np.zeros(len(codes), np.int64)  # a block's codes are its numbers from 0, each once
    for at, value in zip(known.column("codes").to_pylist(), known.column("values").to_pylist()):
        values[np.frombuffer(at, np.int32)] = np.frombuffer(value, np.int64)
    totals, best = values >> 1, values & 1
    n_best, count_sum = [], []
    for packed, times in zip(docs.column("codes").to_pylist(), docs.column("counts").to_pylist()):
        if not packed:
            n_best.append(0)
            count_sum.append(0)
            continue
        at, n = unpack(packed, times)
        n_best.append(int(best[at] @ n))
        count_sum.append(int(totals[at] @ n))
    plain = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*plain, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(held: DataFrame) -> DataFrame:
    """``a_id, b_id, links, best``: links of each id pair over all blocks, and whether no other pair of its B id has more."""
    pairs = held.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select("x.*")
    counted = pairs.groupBy("pairs").agg(F.sum("totals").alias("links"))
    counted = counted.select(F.shiftright("pairs", SHIFT).cast("int").alias("a_id"), F.col("pairs").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b_id"), "links")
    counted = materialize(counted, "id-pairs")
    highest = counted.groupBy("b_id").agg(F.max("links").alias("highest"))  # a row for each id of B at most
    return counted.join(F.broadcast(highest), "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("highest")).alias("best"))


def alignment_statistics(docs: DataFrame, tokenizer: str, model: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs`` (doc_id, text).

    Groups and tokens are those of `alignments`. Links are the pairs of an A and a B token that share a byte; a link's count is the number of
    links of its two ids in all rows. ``n_best`` counts the links whose count is the highest of their B id (ties too), ``count_sum``
    adds the counts up, and ``groups_sha256`` is the digest of the groups written as ``a1,a2|b1;a3|b2,b3``. Rows without
    tokens have zeros and ''. Repeated rows count each.
    """
    shared, texts = _read(docs, tokenizer, model)
    held = materialize(texts.mapInArrow(_blocks(shared, block_bytes), (
        "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "codes binary, counts binary, pairs array<long>, totals array<long>")), "aligned")
    key = F.shiftleft(F.col("a_id").cast("long"), SHIFT).bitwiseOR(F.col("b_id").cast("long"))
    counts = pair_counts(held).select(key.alias("pair"), (F.col("links") * 2 + F.col("best").cast("int")).alias("value"))
    asked = held.where("pairs is not null").select("block", F.posexplode("pairs").alias("code", "pair"))
    back = asked.join(counts, "pair").select("block", "code", "value").mapInArrow(_pack_by_block, "block long, codes binary, values binary")
    rows = held.where("pairs is null").drop("pairs", "totals")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score, STATISTICS)
