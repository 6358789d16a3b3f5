"""Exact dedup: heavy hitters against counts, groups against plain grouping."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewire.llm import exact


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids, default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def found(frame):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in frame.collect())


def test_summary_keeps_every_frequent_digest():
    rng = random.Random(3)
    for counters in (1, 3, 10):
        summary, truth = exact.Summary(counters), Counter()
        for _ in range(40):
            batch = Counter(min(int(rng.expovariate(0.2)), 60) for _ in range(rng.randrange(1, 80)))
            summary.add(batch.items())
            truth += batch
        assert len(summary.counts) <= counters and summary.missed <= truth.total() / (counters + 1)
        for digest, n in truth.items():
            assert n - summary.missed <= summary.counts.get(digest, 0) <= n


def test_heavy_hitters_are_exact(spark):
    rng = random.Random(5)
    texts = ["hot"] * 400 + ["warm"] * 150 + [None] * 60 + [f"text {rng.randrange(300)}" for _ in range(390)]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in exact.heavy_hitters(exact.digests(frame), counters=15).collect()}
    names = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("hot", "warm", "")}
    assert {names[d] for d in got} == {"hot", "warm"}  # 60 of 1,000 rows are not above 1000 // 16 = 62
    for t in ("hot", "warm"):
        assert got[hashlib.sha256(t.encode()).hexdigest()] == (max(i for i, x in enumerate(texts) if x == t), texts.count(t))


def test_groups_with_few_and_many_counters(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", "a", "A", "b ", "b", f"own {rng.randrange(120)}"])) for i in range(600)] + [(599, "twice"), (599, "twice"), (None, "a"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for counters in (2, 4096):
        assert found(exact.exact_groups(frame, counters=counters)) == plain(rows)


def test_normalised_texts(spark):
    frame = spark.createDataFrame([(1, " A "), (2, "a"), (3, "b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(frame, lambda t: F.lower(F.trim(t))).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(exact.exact_groups(odd)) == plain(rows)
    assert exact.exact_groups(odd.limit(0)).count() == 0
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    expected = [(i, t) for i, t in rows if (i, t) not in ((None, None), (1, None))]  # the empty text stays in document 2
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(expected)


def test_remaining_digests_are_the_only_ones_shuffled(spark, odd):
    plan = exact.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and "Window" not in plan
