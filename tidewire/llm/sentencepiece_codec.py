"""SentencePiece encoding and decoding on the tokenizers library.

`Codec` parses the model protobuf and rebuilds the model there: the normaliser (character map, white
space rules, dummy prefix, metaspace marker), the unigram scores or the BPE merges, and byte fallback.

Where no piece has the marker behind another character, nothing joins across the start of a word; texts
are then cut there, and each distinct segment is encoded once per Python worker, in multithreaded batches.
BPE with byte fallback joins two characters only if a piece holds them side by side; texts are then cut between
all others, and new segments are encoded many in a row, with a character between them that no piece holds.
Every segment is compared with the sentencepiece library when it's first seen (``verify``); if the ids
differ, the library's are used and the segment counts as repaired. Models without that property, or with
a normaliser that isn't the identity, are encoded text by text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, models, normalizers

#: Marker of a space within pieces, and kinds of pieces in the protobuf (fixed values of the format).
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Segments that a worker keeps.
CACHE = 300_000
#: Put between segments that are encoded in a row, and how many these are.
BETWEEN, IN_A_ROW = "\n", 500
#: Pairs of neighbouring characters are looked up by so many bits of a hash; a clash only leaves a cut out.
PAIR_BITS, PAIRS_AT_ONCE = 20, 1 << 17


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint32(0x9E3779B1) + second) * np.uint32(0x85EBCA77) >> np.uint32(32 - PAIR_BITS)


class Codec:
    def __init__(self, data: bytes, verify: bool = True):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.kind, self.fallback = proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback
        self.rules = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.verify = verify
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        plain = not self.rules.precompiled_charsmap and not self.rules.remove_extra_whitespaces and self.rules.escape_whitespaces
        no_user = all(p[2] != USER_DEFINED for p in self.pieces)
        self.segmented = plain and no_user and not proto.trainer_spec.treat_whitespace_as_suffix and all(
            MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)
        self.tokenizer = Tokenizer(self._model())
        self.normalizer = self._normalizer()
        self.cache: dict[str, bytes] = {}  # int32; an array for each takes three times the memory
        self.repaired: set[str] = set()
        self.pairs = self._pairs()
        self.bytes = [self._piece_bytes(p, kind) for p, _, kind in self.pieces]

    def _model(self):
        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, byte_fallback=self.fallback)
        if self.kind != BPE:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [(-s, vocab[p], p[:at], p[at:]) for p, s in score.items() for at in range(1, len(p)) if p[:at] in score and p[at:] in score]
        merges.sort(key=lambda m: (m[0], m[1], len(m[2])))
        return models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.fallback)

    def _normalizer(self):
        steps = []
        if self.rules.precompiled_charsmap:
            steps.append(normalizers.Precompiled(self.rules.precompiled_charsmap))
        if self.rules.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.rules.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.rules.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    @staticmethod
    def _piece_bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _pairs(self) -> np.ndarray | None:
        """By hash, whether a piece holds two characters side by side; None where more than that decides what is joined."""
        pieces = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
        if not self.segmented or self.kind != BPE or not self.fallback or any(BETWEEN in p for p in pieces):
            return None
        codes = np.array([(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:])], np.uint32).reshape(-1, 2)
        pairs = np.zeros(1 << PAIR_BITS, bool)
        pairs[pair_hashes(codes[:, 0], codes[:, 1])] = True
        return pairs

    def _cut(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Segments of all texts, and the number of them up to the end of each text."""
        whole, ends = "".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        cut = np.ones(len(whole) + 1, bool)
        for at in range(0, len(whole) - 1, PAIRS_AT_ONCE):
            codes = np.frombuffer(whole[at : at + PAIRS_AT_ONCE + 1].encode("utf-32-le"), np.uint32)
            np.logical_not(self.pairs[pair_hashes(codes[:-1], codes[1:])], out=cut[at + 1 : at + len(codes)])
        cut[ends] = True
        cut[0] = False
        at = np.flatnonzero(cut)
        places = at.tolist()
        return [whole[a:b] for a, b in zip([0, *places], places)], np.searchsorted(at, ends, "right").tolist()

    def _learn_in_rows(self, segments: list[str]) -> None:
        """Ids of segments not seen before, many in a row. Nothing joins across ``BETWEEN``, which is no part of a longer segment."""
        between = next(i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE and p == f"<0x{ord(BETWEEN):02X}>")
        if BETWEEN in segments:
            segments.remove(BETWEEN)
            self.cache[BETWEEN] = np.int32(between).tobytes()
        parts = [segments[at : at + IN_A_ROW] for at in range(0, len(segments), IN_A_ROW)]
        rows = ["".join(BETWEEN + s for s in part) for part in parts]
        for part, row, found in zip(parts, rows, self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)):
            ids = np.array(found.ids, np.int32)
            own = self._split(ids, between)
            if self.verify:
                theirs = np.array(self.library.encode(row)[int(self.rules.add_dummy_prefix) :], np.int32)
                if not np.array_equal(ids, theirs):
                    theirs = self._split(theirs, between)
                    self.repaired.update(s for s, a, b in zip(part, own, theirs) if a != b)
                    own = theirs
            self.cache.update(zip(part, own))

    @staticmethod
    def _split(ids: np.ndarray, between: int) -> list[bytes]:
        """The bytes of what follows each ``between``."""
        raw, at = ids.tobytes(), (4 * np.append(np.flatnonzero(ids == between), len(ids))).tolist()
        return [raw[a + 4 : b] for a, b in zip(at, at[1:])]

    def _learn(self, segments: list[str]) -> None:
        """Ids of segments not seen before, in one batch for all threads of the library."""
        ids = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        if self.verify and self.rules.add_dummy_prefix:
            # the library puts the marker in front itself
            whole = [i for i, s in enumerate(segments) if s[0] == MARK]
            for i, theirs in zip(whole, self.library.encode([segments[i][1:] for i in whole], num_threads=1)):
                if not np.array_equal(ids[i], theirs) and segments[i] != MARK:
                    ids[i] = np.array(theirs, np.int32)
                    self.repaired.add(segments[i])
        self.cache.update(zip(segments, map(np.ndarray.tobytes, ids)))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text, and how many of its segments were repaired."""
        if not self.segmented:
            encoded = self.tokenizer.encode_batch_fast([self.normalizer.normalize_str(t) if t else "" for t in texts], add_special_tokens=False)
            ids = [np.array(x.ids, np.int32) for x in encoded]
            fixed = [0] * len(texts)
            if self.verify:
                for i, theirs in enumerate(self.library.encode([t or "" for t in texts], num_threads=1)):
                    if not np.array_equal(ids[i], theirs):
                        ids[i], fixed[i] = np.array(theirs, np.int32), 1
            return ids, fixed
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.repaired.clear()
        prefix = MARK if self.rules.add_dummy_prefix else ""
        marked = [prefix + t.replace(" ", MARK) if t else "" for t in texts]
        if self.pairs is None:
            parts, learn = [SEGMENT.findall(t) for t in marked], self._learn
        else:
            segments, ends = self._cut(marked)
            parts, learn = [segments[a:b] for a, b in zip([0, *ends], ends)], self._learn_in_rows
        new = list(set().union(*parts).difference(self.cache))
        if new:
            learn(new)
        get, bad = self.cache.__getitem__, self.repaired
        ids = [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]
        return ids, [sum(s in bad for s in p) if bad else 0 for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; invalid bytes become U+FFFD, unknown pieces U+2047 between spaces."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if self.rules.add_dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[tuple[str, bool], Codec] = {}


def _codec(name: str, data, verify: bool) -> Codec:
    """One per worker and model; ``data`` is the broadcast model."""
    if (name, verify) not in _CODECS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        _CODECS[name, verify] = Codec(data.value, verify)
    return _CODECS[name, verify]


def _encoding(name, data, verify):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, data, verify)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = batch.column("text").to_pylist()
                ids, fixed = codec.encode(texts)
                back = [codec.decode(x) == (t or "") for x, t in zip(ids, texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat), pa.array(fixed, pa.int64()), pa.array(back, pa.bool_())],
                    ["doc_id", "n_pieces", "ids", "n_repaired", "round_trip"])

    return run


def encode(docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids, n_repaired, round_trip`` of every row of ``docs`` (doc_id, text).

    ``model`` is a file that the driver reads; its bytes are broadcast (models have a few MB). Ids are those of
    the library, without begin or end. Null and empty texts have no ids. ``round_trip`` tells whether decoding gives
    the text again (empty for null); it can't where the text has the marker U+2581 itself, or where the
    normaliser changes it. Nothing is shuffled; a text is held whole by one task. Other columns are ignored.
    """
    with open(model, "rb") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encoding(f"{len(data)}-{hash(data)}", shared, verify), "doc_id long, n_pieces long, ids array<int>, n_repaired long, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids give a null text, no ids an empty one."""
    with open(model, "rb") as file:
        data = file.read()
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    name = f"{len(data)}-{hash(data)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared, False)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
