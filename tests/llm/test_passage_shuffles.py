"""Chunks and windows, the largest data of `repeated_passages`, are shuffled once and stored nowhere else."""

from tidewire.llm import chunks


def test_chunks_and_windows_are_shuffled_once(spark, monkeypatch):
    plans, write = {}, chunks.materialize

    def noted(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return write(frame, name)

    monkeypatch.setattr(chunks, "materialize", noted)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[at : at + 90]) for at in (0, 20, 200, 210, 20)] + [" ".join(words[:60] * 3)]
    rows = chunks.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_spans"] for r in rows.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1}
    assert sum(p.count("hashpartitioning(key#") for p in plans.values()) == 1
    assert sum(p.count("hashpartitioning(digest#") for p in plans.values()) == 1
    assert not {"chunks", "windows"} & set(plans)
