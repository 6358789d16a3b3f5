"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

Sets are distinct word shingles (hashed to 64 bits). Equal sets are one class and take part once.

1. *Signatures.* SuperMinHash (Ertl, 2017): each element draws a random permutation of the slots and
   puts ``rank + random fraction`` into them; a slot keeps its least value. The ranks of an element
   are correlated, so that each rank is used once, which makes the estimate less variable than with
   independent hashes. Rank after rank is drawn for all documents of a block together, and a document
   stops as soon as none of its slots can be lowered.
2. *Banding.* The slots are cut into bands of ``rows`` values; classes that agree in a band share a
   bucket. The number of bands is chosen so that a pair at the threshold is missed with a chance of at
   most ``MISS``.
3. *Verification* on full sets. In every bucket, each class is compared with the one whose buckets are
   the fullest (of a family of copies, mostly their original): one pair per member, not all pairs.
   Buckets that then still hold several components are dealt into cells of bounded size, in which all
   pairs of different components are compared in memory; only links that hold leave a cell.
4. *Grouping.* Links, contracted by union-find in tasks, become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components, union_find
from .words import U64, mix, shingle_set, signed

#: Largest chance of missing a pair that is just at the threshold.
MISS = 1e-6
#: Elements whose ranks are drawn together.
BLOCK_ELEMENTS = 50_000
#: Members of a block of a bucket, and elements of their sets, on average.
BLOCK_MEMBERS, BLOCK_SIZE = 192, 200_000
_MAX = U64(0xFFFFFFFFFFFFFFFF)


def banding(threshold: float, slots: int = 150) -> tuple[int, int]:
    """Bands and rows: the most selective split whose chance of a miss is at most MISS."""
    for rows in range(slots, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(MISS) / math.log1p(-p))
        if bands * rows <= slots:
            return bands, rows
    raise ValueError("the threshold is too low for so few slots")


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, one row per (non-empty) set: ``rank << 32 | fraction`` of each slot."""
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    signature = np.full(len(sets) * slots, _MAX)
    order = None  # of the slots, by element, as far as drawn
    for rank in range(slots):
        drawn = mix(element + U64(0xD1B54A32D192ED03 * (rank + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = rank + (((drawn >> U64(32)) * U64(slots - rank)) >> U64(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(element))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, rank]
        np.minimum.at(signature, owner * slots + slot, (drawn & U64(0xFFFFFFFF)) | U64(rank << 32))
        # later ranks put at least (rank + 1) << 32: a document without larger values is done
        largest = signature.reshape(-1, slots).max(axis=1)
        going = (largest >= U64((rank + 1) << 32))[owner]
        if not going.any():
            break
        if order is None:
            element, owner, pick = element[going], owner[going], pick[going]
            order = np.tile(np.arange(slots, dtype=np.int16), (len(element), 1))
            row = np.arange(len(element))
            order[row, pick] = order[row, 0]
        elif not going.all():
            element, owner, order = element[going], owner[going], order[going]
    return signature.reshape(-1, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, different for equal values in different bands."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), parts.shape[:2]).copy()
    for row in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return key


def _signing(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, digests, keys = np.zeros(n, np.int64), [None] * n, [None] * n
            held, where, total = [], [], 0

            def flush():
                signed_keys = signed(band_keys(superminhash(held, bands * rows), bands, rows))
                for at, row in zip(where, signed_keys):
                    keys[at] = row

            for at, text in enumerate(batch.column("text").to_pylist()):
                elements = shingle_set(text, size)
                counts[at] = len(elements)
                if len(elements):
                    digests[at] = xxhash.xxh3_128_digest(elements.tobytes())
                    held.append(elements)
                    where.append(at)
                    total += len(elements)
                if total > BLOCK_ELEMENTS:
                    flush()
                    held, where, total = [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(counts), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "hash", "n_shingles", "class", "keys"])

    return sign


def _sets(size: int):
    """Whole sets of the wanted texts; a row whose doc_id is used by another text, too, is left out."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for name, text in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist()):
                data = shingle_set(text, size).tobytes()
                if xxhash.xxh3_128_digest(data) == name:
                    names.append(name)
                    sets.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["class", "elements"])

    return build


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _verifying(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, elements = None, None
        for batch in batches:
            a, b = batch.column("class").to_pylist(), batch.column("pivot").to_pylist()
            mine, theirs = batch.column("elements"), batch.column("pivot_elements")
            keep = []
            for at, pivot in enumerate(b):
                if pivot != name:
                    name, elements = pivot, np.frombuffer(theirs[at].as_py(), U64)
                if similar(np.frombuffer(mine[at].as_py(), U64), elements, percent):
                    keep.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[x] for x in keep], pa.binary()), pa.array([b[x] for x in keep], pa.binary())], ["u", "v"])

    return verify


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[column] > 1
    place = np.cumsum(count > 1) - 1
    column, owner = place[column[often]], owner[often]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 1 << 13
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        start, end = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[start:end], column[start:end] - low] = 1
        out += part @ part.T
    return out


def _in_cells(percent: int):
    """Links between members of a cell that are in different components, as a spanning forest."""
    def links(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, U64) for x in frame["elements"]]
        roots, names = frame["root"].tolist(), frame["class"].tolist()
        shared = _shared(sets)
        sizes = np.array([len(x) for x in sets], np.float64)
        union = sizes[:, None] + sizes[None, :] - shared
        code = pd.factorize(pd.Series(roots))[0]
        hit = np.argwhere(np.triu(100 * shared >= percent * union, 1) & (code[:, None] != code[None, :]))
        found = union_find((names[a], names[b]) for a, b in hit)
        return pd.DataFrame([(x, root) for x, root in found.items() if x != root], columns=["u", "v"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []
        for frame in frames:  # sorted by cell
            for key, part in frame.groupby("cell", sort=False):
                if key != cell and held:
                    yield links(pd.concat(held))
                    held = []
                cell = key
                held.append(part)
        if held:
            yield links(pd.concat(held))

    return run


def _cells(members: DataFrame) -> DataFrame:
    """Members of pending buckets, dealt into blocks; each pair of blocks of a bucket is a cell."""
    size = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements_n"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("elements_n") / BLOCK_SIZE)).cast("int")
    dealt = members.join(size.select("bucket", blocks.alias("blocks")), "bucket")
    block = F.expr("cast(pmod(xxhash64(class, bucket), blocks) as int)")
    return dealt.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "class", "root", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, hash, n_shingles, component_id, root`` of each row of ``docs`` (doc_id long, text string).

    Rows are linked if their sets of ``size``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; ``component_id`` is the least doc_id that links reach. ``hash`` is the 64-bit hash
    of the text, ``root`` tells components apart also where doc_ids repeat. Texts with fewer words have one shingle of all their words; null, empty and blank texts
    have none, are linked with nothing and are their own component (null root). Rows that repeat a doc_id are rows
    of their own. A null doc_id stays null unless a link reaches another; it is never the least one.
    Other columns are ignored.
    """
    bands, rows = banding(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    signed_rows = materialize(texts.mapInArrow(
        _signing(size, bands, rows), "doc_id long, hash long, n_shingles long, class binary, keys array<long>"), "signatures")

    classes = signed_rows.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    bucketed = classes.select("class", F.explode("keys").alias("bucket"))
    full = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    live = materialize(bucketed.join(full, "bucket"), "buckets")
    fame = live.groupBy("class").agg(F.sum("n").alias("fame"))
    # the pivot of a bucket: its member with the fullest buckets
    pivots = live.join(fame, "class").groupBy("bucket").agg(F.max(F.struct("fame", "class")).alias("top"))
    stars = live.join(pivots.select("bucket", F.col("top.class").alias("pivot")), "bucket")
    pairs = stars.where("class <> pivot").select("class", "pivot").distinct()

    wanted = live.select("class").distinct().join(classes.select("class", F.col("doc_id").alias("least"), "n_shingles"), "class")
    sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select("class", "text")
    sets = materialize(sets.mapInArrow(_sets(size), "class binary, elements binary").dropDuplicates(["class"]), "sets")

    theirs = sets.select(F.col("class").alias("pivot"), F.col("elements").alias("pivot_elements"))
    joined = pairs.join(sets, "class").join(theirs, "pivot")
    links = materialize(joined.mapInArrow(_verifying(percent), "u binary, v binary"), "links")
    found = components(links, "u", "v")

    # buckets of two are settled by their one pair; others are, if all are in one component
    rooted = live.where("n > 2").join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "bucket", "class", F.coalesce("root", "class").alias("root"))
    pending = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    members = rooted.join(pending, "bucket").join(wanted.select("class", "n_shingles"), "class")
    cells = _cells(members).join(sets, "class")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInPandas(_in_cells(percent), "u binary, v binary")
    more = materialize(more, "links")
    found = components(found.toDF("u", "v").union(more), "u", "v")

    root = F.coalesce("root", "class")
    named = classes.select("class", "doc_id").join(found.withColumnRenamed("node", "class"), "class", "left")
    least = named.groupBy(root.alias("root")).agg(F.min("doc_id").alias("component_id"))
    named = named.select("class", root.alias("root")).join(least, "root").select("class", "component_id", "root")
    return signed_rows.drop("keys").join(named, "class", "left").select(
        "doc_id", "hash", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` of which each group keeps one: the least doc_id, of ties the least hash of the text.

    Rows without words are kept. Repeated rows are one document and are kept once. All columns stay.
    """
    groups = near_groups(docs, size, percent)
    best = groups.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("best")).select(
        F.col("best.doc_id").alias("kept_id"), F.col("best.hash").alias("kept_hash"))
    none = groups.where("root is null").select(F.col("doc_id").alias("kept_id"), F.col("hash").alias("kept_hash"))
    kept = best.union(none).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    on = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    return rows.join(kept, on).dropDuplicates(["id", "hash"]).select("row.*")
