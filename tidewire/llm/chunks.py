"""Substring dedup by content-defined chunking and keys of whole passages.

1. *Chunks.* A gear hash rolls over the bytes of a text; a chunk ends where the upper bits of the hash are below a
   limit. As only the last 16 bytes decide, equal passages are cut alike wherever they stand, and an
   insertion shifts nothing beyond the chunk it falls in. Chunks of fewer than ``MIN_CHUNK`` bytes aren't indexed.
2. *Windows.* A window runs from the begin of a word to the first character of the ``min_words``-th. It can only be repeated if
   several texts hold each chunk that its own bytes decide; windows without such chunks may be, too. All of these get two
   keys at each place where they occur: the hash of their bytes, and that with all of the last word.
3. *Holders.* A key that several texts hold points from each place in the later ones to its first holder (least doc_id), which
   has the whole window: one pointer per place, by a minimum over the key's rows, never all pairs of holders. Texts are numbered
   in the order of their doc_ids, so that a place is one number and the first holder a minimum. Chunks and windows are shuffled once, and stored nowhere else.
4. *Spans.* Pointers from a text to one holder and on one diagonal are one candidate; the bytes of both texts are compared
   along the diagonal, from the pointers on as far as they are equal, and runs with at least ``min_words`` words are repeated passages. A
   pointer whose window lies in a run found before isn't followed, so that texts of one repeated pattern, with a diagonal for each
   place, take time in proportion to their length.

Copies of a whole text are folded first, by a digest of 128 bits; one of them takes part in the steps above. The different texts are a table
bucketed by that digest: chunks, windows, comparison and result read it in place, and only a text that points to a holder moves to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir, local_frame, materialize
from .words import HASHES, U64, mix, shingle_hashes

#: Mean distance of cuts, least indexed and largest chunk, in bytes.
MEAN_CHUNK, MIN_CHUNK, MAX_CHUNK = 24, 16, 512
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
#: Places are numbers of texts above starts in bytes: 2^34 different texts of up to 2^29 bytes.
START_BITS = 29
#: Pointers of one diagonal are taken together within so many bytes.
SEGMENT = 4096
WHITE = r"\x20\x09-\x0D"
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after each byte: ``h = (h << 1) + gear[byte]`` in 16 bits, for all bytes at once."""
    rolled = _GEAR[data]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(rolled)
        older[width:] = rolled[:-width] << np.uint16(width)
        rolled = rolled + older
    return rolled


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text's bytes, and those of them that the hash gave."""
    found = np.flatnonzero(gear(data) < (1 << 16) // MEAN_CHUNK) + 1
    ends = np.unique(np.concatenate([found, [len(data)]])) if len(data) else found
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    long = np.flatnonzero(ends - starts > MAX_CHUNK)
    if len(long):  # without a cut for very long: cut at fixed distances from the last one
        more = [np.arange(starts[i] + MAX_CHUNK, ends[i], MAX_CHUNK) for i in long]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends, found


def chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the indexed chunks: those that the bytes from 16 before their start decide."""
    ends, found = cuts(np.frombuffer(data, np.uint8))
    starts = np.concatenate([[0], ends[:-1]])
    keep = (ends - starts >= MIN_CHUNK) & np.isin(starts, found) & ((ends < len(data)) | np.isin(ends, found))
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), U64, len(starts))


def _chunking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist()):
            own = np.unique(chunks_of(text.encode())[2])
            digests.append(own.view(np.int64))
            owners.append(np.full(len(own), number, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), pa.array(np.concatenate(owners))], ["digest", "number"])


def first_characters(data: bytes, at: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of the characters that begin at some places, as numbers."""
    padded = np.frombuffer(data + b"   ", np.uint8)
    code, inside = padded[at].astype(U64), np.ones(len(at), bool)
    for shift in (1, 2, 3):
        inside &= padded[at + shift] & 0xC0 == 0x80
        code = np.where(inside, code << U64(8) | padded[at + shift], code)
    return code


def windows(data: bytes, repeated: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the windows in which all chunks are among the ``repeated`` digests."""
    begins = np.flatnonzero(np.diff(word_counts(np.frombuffer(data, np.uint8))))
    n = len(begins) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    last = begins[min_words - 1 :]
    starts, ends, digests = chunks_of(data)
    single = ~np.isin(digests, repeated)
    # a chunk lies in the windows from the first that ends behind it to the last that begins 16 bytes before it
    low = np.searchsorted(last + 1, ends[single])
    high = np.searchsorted(begins[:n], starts[single] - 16, "right")
    low, high = low[low < high], high[low < high]
    closed = np.zeros(n + 1, np.int64)
    np.add.at(closed, low, 1)
    np.add.at(closed, high, -1)
    at = np.flatnonzero(np.cumsum(closed[:n]) == 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    edges = [*begins.tolist(), len(data)]
    tokens = [data[a:b] for a, b in zip(edges, edges[1:])]  # with the white space behind
    final = [x.rstrip() for x in tokens[min_words - 1 :]]
    keys = np.concatenate([mix(first_characters(data, last) + U64(1)), mix(HASHES.of(final))])
    if min_words > 1:
        keys = mix(keys ^ np.tile(shingle_hashes(HASHES.of(tokens[:-1]), min_words - 1), 2))
    return np.tile(begins[at], 2), keys[np.concatenate([at, at + n])]


def _keying(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for number, text, digests in zip(*(batch.column(c).to_pylist() for c in ("number", "text", "digests"))):
                starts, own = windows(text.encode(), np.array(digests or [], np.int64).view(U64), min_words)
                keys.append(own.view(np.int64))
                places.append(number << START_BITS | starts)
                total += len(own)
                if total > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, places)], ["key", "place"])
                    keys, places, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, places)], ["key", "place"])

    return run


def word_counts(data: np.ndarray) -> np.ndarray:
    """Words that begin before each position (one more position than bytes)."""
    space = _SPACES[data]
    begins = ~space & np.concatenate([[True], space[:-1]])
    return np.concatenate([[0], np.cumsum(begins)])


def equal_runs(mine: np.ndarray, theirs: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Runs of ``mine`` that equal ``theirs`` at ``shift`` bytes before."""
    low, high = max(0, shift), min(len(mine), len(theirs) + shift)
    if low >= high:
        return []
    equal = np.concatenate([[False], mine[low:high] == theirs[low - shift : high - shift], [False]])
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + low
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def at_characters(data: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The run without bytes of characters that it holds only in part."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def equal_length(mine: np.ndarray, theirs: np.ndarray) -> int:
    """How many bytes both have in common from their begin on; looked at in blocks of growing size."""
    length, at, size = min(len(mine), len(theirs)), 0, 64
    while at < length:
        end = min(at + size, length)
        other = np.flatnonzero(mine[at:end] != theirs[at:end])
        if len(other):
            return at + int(other[0])
        at, size = end, 2 * size
    return length


def passages(data: bytes, theirs: bytes, pointers: list[tuple[int, int, int]], min_words: int) -> list[tuple[int, int]]:
    """Runs of at least ``min_words`` words that ``theirs`` holds, too, along the pointers: first and last window's start, and shift.

    A window that a run found before covers isn't looked at again.
    """
    mine, other = np.frombuffer(data, np.uint8), np.frombuffer(theirs, np.uint8)
    words = word_counts(mine)
    begins = np.append(np.flatnonzero(np.diff(words)), len(mine))
    found: list[tuple[int, int]] = []
    covered = (0, 0)  # the run that reaches furthest
    for low, high, shift in sorted(pointers):
        stop = int(begins[min(words[high] + min_words, len(begins) - 1)])  # where the word behind the last window begins
        if covered[0] <= low and stop <= covered[1]:
            continue
        first = max(0, shift)
        if low >= covered[1]:
            low -= equal_length(mine[first:low][::-1], other[first - shift : low - shift][::-1])
        stop = min(stop, len(other) + shift)
        stop += equal_length(mine[stop:], other[stop - shift :])
        for start, end in equal_runs(mine[low:stop], other[low - shift : stop - shift], 0):
            start, end = at_characters(mine, low + start, low + end)
            if words[end] - words[start] >= min_words:
                found.append((start, end))
                covered = max(covered, (start, end), key=lambda run: run[1])
    return found


def _comparing(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["number", "start", "end", "holder"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for number, holder, pointers, text, theirs in zip(*(batch.column(c).to_pylist() for c in ("number", "holder", "pointers", "text", "holder_text"))):
                pointers = [(p["low"], p["high"], p["shift"]) for p in pointers]
                rows += [(number, start, end, holder) for start, end in _merged(passages(text.encode(), theirs.encode(), pointers, min_words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], names)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_spans", "dropped_bytes", "spans", "holders", "kept_text", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, text, spans, holders, copy_of, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "holders", "copy_of", "size"))):
            if copy_of is not None:
                rows.append((doc_id, size, 1, size, [[0, size]], [copy_of], "", hashlib.sha256().hexdigest()))
                continue
            data = (text or "").encode()
            merged, kept, last = _merged([(s["start"], s["end"]) for s in spans or ()]), [], 0
            for start, end in merged:
                kept.append(data[last:start])
                last = end
            kept = b"".join([*kept, data[last:]])
            rows.append((doc_id, len(data), len(merged), len(data) - len(kept), [list(s) for s in merged], sorted(holders or ()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], names)


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """The rows, which are hashed by ``key`` already, as a table that joins by it read in place."""
    spark, name = rows.sparkSession, f"distinct_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.option("compression", "zstd").option("path", fresh_dir(spark, "distinct-texts")).bucketBy(buckets, key).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay for as long as the result is read
    return stored


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows, written in ``order`` and numbered from 0 on in column ``number``. The driver holds one count per part."""
    part, index = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    rows = materialize(rows.orderBy(*order).withColumn("id", F.monotonically_increasing_id()), name)
    total, offsets = 0, []
    for row in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["count"]
    offsets = local_frame(rows.sparkSession, offsets, "part long, offset long")
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("number", F.col("offset") + index).drop("id", "part", "offset")


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_spans, dropped_bytes, spans, holders, kept_text, kept_sha256`` of each row of ``docs`` (doc_id, text).

    A passage is dropped, wherever it stands, if a text with a smaller doc_id holds it, too, and it has at least ``min_words``
    words (begun in it, and in the other text). ``spans`` are [start, end) in UTF-8 bytes, ``holders`` the doc_ids that the passages were compared with.
    A copy of a whole text with as many words is dropped whole, of equal doc_ids all but the first; shorter copies stay. Null, empty and blank texts lose
    nothing; their kept text is empty if null. A null doc_id counts as larger than all others. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = base.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    last = F.lit((1 << 63) - 1)
    full = hashed.where("length(text) > 0").withColumn("doc_id", F.coalesce("doc_id", last))
    table = bucketed(full.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("text").alias("text")), "text_key")
    texts = numbered(table.select("text_key", "least", "copies"), ["least", "text_key"], "texts")
    names = texts.select("number", "text_key")

    # shorter texts hold no passage
    one = table.where(F.length("text") >= 2 * min_words - 1).select("text_key", "text").join(names, "text_key")
    chunks = one.select("number", "text").mapInArrow(_chunking, "digest long, number long")
    of_digest = Window.partitionBy("digest")
    shared = chunks.withColumn("a", F.min("number").over(of_digest)).withColumn("b", F.max("number").over(of_digest)).where("a <> b")
    repeated = shared.groupBy("number").agg(F.collect_list("digest").alias("digests"))
    repeated = repeated.join(names, "number").select("text_key", "digests")
    keyed = one.join(repeated, "text_key", "left").select("number", "text", "digests").mapInArrow(_keying(min_words), "key long, place long")

    text_of, start_of = lambda place: F.shiftright(place, START_BITS), lambda place: F.col(place).bitwiseAND((1 << START_BITS) - 1).cast("int")
    pointers = keyed.withColumn("first", F.min("place").over(Window.partitionBy("key"))).where(text_of("first") < text_of("place")).select(
        text_of("place").alias("number"), text_of("first").alias("holder"), start_of("place").alias("start"), (start_of("place") - start_of("first")).alias("shift"))
    pointers = pointers.groupBy("number", "holder", "shift", F.expr(f"start div {SEGMENT}")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    pairs = materialize(pointers.groupBy("number", "holder").agg(F.collect_list(F.struct("low", "high", "shift")).alias("pointers")), "pairs")

    holders = texts.select(F.col("number").alias("holder"), F.col("text_key").alias("holder_key"), F.col("least").alias("held_by"))
    joined = pairs.join(names, "number").join(holders, "holder").join(table.select("text_key", "text"), "text_key")
    joined = joined.join(table.select(F.col("text_key").alias("holder_key"), F.col("text").alias("holder_text")), "holder_key")
    spans = joined.select("number", F.col("held_by").alias("holder"), "pointers", "text", "holder_text").mapInArrow(
        _comparing(min_words), "number long, start int, end int, holder long")
    spans = spans.groupBy("number").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.collect_set("holder").alias("holders"))
    spans = spans.join(names, "number").select("text_key", "spans", "holders")

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("spans", "array<struct<start:int,end:int>>"), ("holders", "array<long>"), ("copy_of", "long"))]
    size = F.octet_length("text").cast("long").alias("size")
    firsts = table.join(spans, "text_key", "left").select(F.col("least").alias("doc_id"), "text", "spans", "holders", none[2], size)
    # all rows of texts with copies, but for one with the least doc_id
    is_long = F.col("text").rlike(rf"\A[{WHITE}]*+(?:[^{WHITE}]++[{WHITE}]++){{{min_words - 1}}}[^{WHITE}]")  # reads that many words only
    narrow = full.select("doc_id", "text_key", size, is_long.alias("long"), "text").withColumn("text", F.expr("if(long, null, text)"))
    copies = materialize(narrow.join(texts.where("copies > 1").select("text_key", "least"), "text_key"), "copies")
    copy_of = F.when(F.col("long"), F.col("least")).alias("copy_of")
    later = copies.where("doc_id > least").select("doc_id", "text", *none[:2], copy_of, "size")
    ties = copies.where("doc_id = least").groupBy("doc_id", "least", "text_key", "text", "long", "size").count().where("count > 1")
    ties = ties.withColumn("tie", F.explode(F.sequence(F.lit(2), F.col("count")))).select("doc_id", "text", *none[:2], copy_of, "size")
    empty = hashed.where("text is null or text = ''").select("doc_id", "text", *none, size)
    rows = firsts.unionByName(later).unionByName(ties).withColumn("doc_id", F.nullif("doc_id", last)).unionByName(empty)
    return rows.mapInArrow(
        _cutting, "doc_id long, n_bytes long, n_spans long, dropped_bytes long, spans array<array<int>>, holders array<long>, kept_text string, kept_sha256 string")
