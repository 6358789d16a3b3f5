"""A model is given a bounded number of bytes at once, however Spark batches its rows."""

from tidewire import operators as op
from tidewire.catalogue import bindings as b
from tidewire.operators import scoring


def test_a_model_is_given_few_bytes_at_once(spark):
    over, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        def predict(batch):
            over.add(len(batch) > 1 and sum(len(text) for text in batch) > 4_000_000)
            seen.add(len(batch))
            return [[("Positive", 1.0 / (1 + len(text)))] for text in batch]

        return predict

    sizes = [200_000] * 60 + [6_000_000, 0, 1]
    frame = spark.range(len(sizes)).selectExpr("cast(id as string) as headline_id", f"repeat('x', array({','.join(map(str, sizes))})[cast(id as int)]) as title").repartition(1)
    scored = op.model_score(frame, load, "m", b.lexicon(spark)).collect()
    assert {int(r.headline_id): r.score for r in scored} == {i: 1.0 / (1 + n) for i, n in enumerate(sizes)}
    assert seen.value == len(sizes) and over.value == 0


def test_only_failed_texts_leave_the_worker(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"headline_id": ["a", "b", "c", None], "title": ["good", "fail", None, "none"]})

    def predict(texts):
        if "fail" in texts:
            raise ValueError
        return [[] if text == "none" else [("Positive", 1.0)] for text in texts]

    got = [r for part in scoring._classify(lambda: predict, 4)(iter([batch])) for r in part.to_pylist()]
    assert [(r["headline_id"], r["title"], r["probs"]) for r in got] == [
        ("a", None, [("Positive", 1.0)]), ("b", "fail", None), ("c", None, [("Positive", 1.0)]), (None, "none", [])]
