"""Alignment of two tokenizers against a plain version that looks at every pair of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidewire.llm import alignment
from tidewire.llm.queries import queries

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_groups(ends_a, ends_b):
    """(first and last number of A, of B) of each group, by the set of common offsets."""
    cuts = sorted(set(ends_a) & set(ends_b))
    out, a, b = [], 0, 0
    for cut in cuts:
        x, y = ends_a.index(cut), ends_b.index(cut)
        out.append((a, x, b, y))
        a, b = x + 1, y + 1
    return out


def test_diagonal_against_common_offsets():
    rng = random.Random(1)
    for trial in range(400):
        size = rng.choice([1, 2, 5, 40, 300])
        share = rng.choice([0.05, 0.5, 0.95])
        base = sorted(rng.sample(range(1, 4 * size + 2), size))
        a = sorted({x for x in base if rng.random() < share} | {base[-1]} | ({rng.randrange(1, base[-1] + 1)} if trial % 2 else set()))
        b = sorted({x for x in base if rng.random() < share} | {base[-1]})
        found = alignment.diagonal(np.array(a, np.int32), np.array(b, np.int32))
        groups = plain_groups(a, b)
        assert set(range(len(a))) - set(found.inner_a) == {x for _, x, _, _ in groups}
        assert set(range(len(b))) - set(found.inner_b) == {y for _, _, _, y in groups}
        starts_a, starts_b = [0, *a], [0, *b]
        overlaps = [(x, y) for x in range(len(a)) for y in range(len(b)) if starts_a[x] < b[y] and starts_b[y] < a[x]]
        assert sorted([(x + k, y + k) for x, y, n in found.runs for k in range(n)] + list(zip(found.links_a, found.links_b))) == overlaps
    same = np.arange(1, 100_001, dtype=np.int32)
    assert alignment.diagonal(same, same) == ([(0, 0, 100_000)], [], [], [], [])  # one run, whatever its length
    assert alignment.diagonal(same[:0], same[:0]) == ([], [], [], [], [])


def plain(rows):
    """The contract's columns by comparing the byte ranges of all pairs of tokens."""
    first, second = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    decode = {c: b for c, b in alignment._byte_alphabet().items()}
    docs, counts = [], Counter()
    for i, t in rows:
        ids_a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = second.encode(t) if t else []
        bytes_a = [bytes(decode[c] for c in first.id_to_token(x)) for x in ids_a]
        pieces = [second.id_to_piece(x) for x in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(ids_b, pieces)]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, y = [], 0
        for x, end in enumerate(ends_a):
            begin = ends_a[x - 1] if x else 0
            while y and (ends_b[y - 1] > begin):
                y -= 1
            while ends_b[y] <= begin:
                y += 1
            z = y
            while z < len(ends_b) and (ends_b[z - 1] if z else 0) < end:
                links.append((ids_a[x], ids_b[z]))
                z += 1
        common_a, common_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        groups, p, q = [], 0, 0
        for cut in sorted(common_a.keys() & common_b.keys()):
            groups.append((ids_a[p : common_a[cut] + 1], ids_b[q : common_b[cut] + 1]))
            p, q = common_a[cut] + 1, common_b[cut] + 1
        counts.update(links)
        docs.append((i, ids_a, ids_b, links, groups))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, ids_a, ids_b, links, groups in docs:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return Counter(out)


def found(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_statistics_of_documents(spark, documents, doc_rows):
    assert found(queries()["op12_token_alignment"](spark, "/root/testdata/sf0.001")) == plain(doc_rows)
    several = alignment.alignment_statistics(documents.repartition(3), BPE, PIECES, block_bytes=20_000)
    assert found(several) == plain(doc_rows)


def test_odd_rows(spark, odd):
    more = [(20, "marker ▁ inside"), (21, "<s> </s> <0x41> <unk> <|endoftext|>"), (22, "\x00\x01   ﻿­"), (23, " "), (24, "ａ🙂‍👩🏽‍🚀 é"), (25, "\r\n\t  x   "), (26, "a" + " " * 30_000 + "b\n" * 5_000)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + more
    frame = odd.select("doc_id", "text", "n", "block", "codes").union(spark.createDataFrame([(i, t, "", "", "") for i, t in more], "doc_id long, text string, n string, block string, codes string"))
    assert found(alignment.alignment_statistics(frame, BPE, PIECES)) == plain(rows)
    assert alignment.alignment_statistics(odd.limit(0), BPE, PIECES).count() == 0


def test_groups_spell_the_text(spark, documents):
    docs = documents.limit(40)
    first, second = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stats = {r["doc_id"]: r for r in alignment.alignment_statistics(docs, BPE, PIECES).collect()}
    for row in alignment.alignments(docs, BPE, PIECES).collect():
        text = texts[row["doc_id"]]
        assert [x for g in row["groups"] for x in g["a_ids"]] == (first.encode(" " + text, add_special_tokens=False).ids if text else [])
        assert [x for g in row["groups"] for x in g["b_ids"]] == (second.encode(text) if text else [])
        written = ";".join(",".join(map(str, g["a_ids"])) + "|" + ",".join(map(str, g["b_ids"])) for g in row["groups"])
        assert stats[row["doc_id"]]["groups_sha256"] == (hashlib.sha256(written.encode()).hexdigest() if written else "")
        assert not text or row["groups"][-1]["end"] == len(text.encode()) + 1
