"""Every stage of the pipeline against a plain version, on what its predecessor kept."""

import brute
from paths import SMALL

import corpus_pipeline


def test_stages(spark, documents, tmp_path):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
        pairs = [(i, t) for i, _, t in before]
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "sentencepiece":
            assert {r["doc_id"]: r["round_trip"] for r in docs.collect()} == {i: True for i, _ in pairs}
            break
        assert docs.columns == documents.columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert after.keys() == {i for i, x in brute.quality(before).items() if x[-1]}
        elif name == "line_dedup":
            assert after == {i: x[2] for i, x in brute.deduped_lines(pairs).items()}
        elif name == "near_dedup":
            groups = brute.near_groups(pairs, 5, 80)
            assert after.keys() == {i for i, (n, root) in groups.items() if i == root or not n}
        else:
            assert after.keys() == {i for i, _ in pairs} - {i for i, _ in brute.contaminated(pairs, items)}
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
