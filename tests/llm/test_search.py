"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidewire.llm import search
from tidewire.llm.queries import queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            if not bag:
                continue
            m = 50 + 50 * bag.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out.update((item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1))
    return out


def found(frame):
    return Counter(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


def test_terms():
    text = "Ünïcode ÀB_c3-d  É's\x7fx y 日本。"
    assert [t.decode() for t in search.terms_of(text)] == terms(text)


def test_whole_tables(spark, documents, doc_rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    expected = plain(doc_rows, items)
    assert found(queries()["op13_lexical_search"](spark, "/root/testdata/sf0.001")) == expected
    small = search.ranked_search(documents.repartition(3), bench, block_bytes=10_000, item_bytes=3_000)
    assert found(small) == expected


def test_ties_repeats_and_frequent_words(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i // 2, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.choice([3, 8, 8, 8, 40])))) for i in range(500)]
    docs += [(None, "w1 w29"), (None, "w1 w29"), (900, "w1 w29"), (901, "w1 w29")]
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(40)] + [(1, "w29 w28"), (1, "w29 w28"), (None, "w3 w3 W3"), (50, None), (51, "unseen"), (52, "!")]
    docs_frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items_frame = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 7, 600):
        assert found(search.ranked_search(docs_frame, items_frame, k=k, block_bytes=2_000)) == plain(docs, items, k)


def test_accumulators_are_limited():
    rng = np.random.default_rng(4)
    n = 5_000
    sizes = {0: 20, 1: 60, 2: 4_000, 3: 4_500}
    docs = {t: np.sort(rng.choice(n, size, replace=False)).astype(np.int32) for t, size in sizes.items()}
    row = {"doc_ids": list(range(n)), "lengths": [100] * n, "terms": list(sizes), "dfs": list(sizes.values()),
           "docs": b"".join(d.tobytes() for d in docs.values()), "tfs": b"".join(np.ones(s, np.int32).tobytes() for s in sizes.values())}
    block, weights = search.Block(row, n, 100 * n), [(t, search.weight(n, size)) for t, size in sizes.items()]
    best = search.Best(10)
    created, made = search.search(block, weights, best)
    assert created <= 80 and made <= 2  # the frequent terms make none
    sums = np.zeros(n, np.int64)
    for t, w in weights:
        sums[docs[t]] += w * block.lists[t][1]
    order = np.lexsort((np.arange(n), -sums))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == sums[order].tolist()


def test_odd_rows(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "one two"), (2, "no id but a text"), (3, None), (4, ""), (5, "日本語のテキスト" * 20), (6, "word17 filler3 endoftext")]
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], "item_id long, text string, rank string, number string")
    assert found(search.ranked_search(odd, frame)) == plain(docs, items)
    assert search.ranked_search(odd.limit(0), frame).count() == 0
    empty = search.ranked_search(odd, frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
