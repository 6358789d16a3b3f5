import pytest
from frames import rows

from tidewire import operators as op
from tidewire.operators import scoring
from tidewire.schemas import LEXICON
from tidewire.session import local_frame


def lexicon(spark):
    return local_frame(spark, [("good", 2.0), ("bad", -2.0)], LEXICON)


def texts(spark, titles):
    return local_frame(spark, [(str(n), title) for n, title in enumerate(titles)], "headline_id string, title string")


def test_fold_probabilities(spark):
    cases = spark.sql("""select * from values
        (0, map('Positive', 0.7D, 'Negative', 0.2D, 'Neutral', 0.1D)),
        (1, map('neutral', 0.4D, 'positive', 0.4D, 'negative', 0.2D)),
        (2, map('other', 0.9D)),
        (3, cast(map() as map<string, double>)),
        (4, cast(null as map<string, double>)),
        (5, map('NEGATIVE', 0.9D)),
        (6, map('A', 0.9D, 'b', 0.5D, 'a', 0.1D)) as t(id, probs)""")
    folded = op.fold_probabilities(cases)
    got = rows(folded.selectExpr("id", "label", "round(score, 6)", "confidence"))
    assert got == [
        (0, "positive", 0.5, 0.7), (1, "neutral", 0.2, 0.4), (2, "other", 0.0, 0.9), (3, None, None, None),
        (4, None, None, None), (5, "negative", -0.9, 0.9), (6, "b", 0.0, 0.5),
    ]


def shouting_model():
    def load():
        def predict(batch):
            if any("fail" in text for text in batch):
                raise ValueError("bad batch")
            return [[("Positive", 0.9), ("Negative", 0.1)] if text.isupper() else [("Negative", 1.0)] for text in batch]

        return predict

    return load


def test_model_and_its_fallback(spark):
    frame = texts(spark, ["LOUD", "quiet good"]).repartition(1)
    scored = op.model_score(frame, shouting_model(), "shout", lexicon(spark))
    assert rows(scored) == [("0", "positive", 0.8, 0.9, "shout"), ("1", "negative", -1.0, 1.0, "shout")]
    failing = op.model_score(texts(spark, ["fail good", "bad", None]).repartition(1), shouting_model(), "shout", lexicon(spark))
    assert [(row.label, row.model) for row in failing.orderBy("headline_id").collect()] == [
        ("positive", "vader"), ("negative", "shout"), ("negative", "shout")]


@pytest.mark.parametrize("batch", ["1", "10", "10000"])
def test_a_failing_text_falls_back_alone(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = texts(spark, ["LOUD" if n % 2 else "quiet" for n in range(60)] + ["good fail"]).repartition(1)
        scored = op.model_score(frame, shouting_model(), "shout", lexicon(spark))
        assert [row.headline_id for row in scored.collect() if row.model == "vader"] == ["60"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_results_are_a_failure(spark):
    def load():
        return lambda batch: []

    assert [row.model for row in op.model_score(texts(spark, ["good"]), load, "m", lexicon(spark)).collect()] == ["vader"]


def test_model_sees_every_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(batch):
            seen.add(len(batch))
            return [[("Positive", 1.0)] for _ in batch]

        return predict

    scored = op.model_score(texts(spark, ["good"] * 30), load, "m", lexicon(spark))
    assert scored.count() == 30 and scored.where("model = 'm'").count() == 30
    assert seen.value == 30


def test_scored_rows_are_not_shuffled_again(spark):
    scored = op.model_score(texts(spark, ["LOUD"] * 40 + ["fail good"]), shouting_model(), "shout", lexicon(spark))
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    model_side = plan[: plan.index("shout")].count("Exchange")
    assert model_side == 0 and "MapInPandas" not in plan
    # the lexicon's side reads the failed texts only
    assert "isnull(score" in plan and "isnotnull(score" in plan
    assert sorted(row.model for row in scored.collect()) == ["shout"] * 40 + ["vader"]


def test_backends(spark):
    frame = texts(spark, ["good"])
    assert op.score(frame, lexicon=lexicon(spark)).first().model == "vader"
    with pytest.raises(ValueError, match="unknown scoring backend"):
        op.score(frame, "nothing")
    op.register_backend("shout", lambda headlines, **options: op.model_score(headlines, shouting_model(), "shout", **options))
    try:
        assert op.score(frame, lexicon=lexicon(spark)).first().model == "shout"
        assert op.score(frame, "vader", lexicon=lexicon(spark)).first().model == "vader"
    finally:
        del scoring._backends["shout"]


def test_empty_input(spark):
    frame = texts(spark, ["x"]).limit(0)
    assert op.score(frame, "vader", lexicon=lexicon(spark)).count() == 0


def test_pending_only(spark):
    headlines = texts(spark, ["good", "bad"]).selectExpr("*", "'A' as ticker")
    scores = local_frame(spark, [("0", "neutral", 0.0, 1.0, "old")],
                         "headline_id string, label string, score double, confidence double, model string")
    pending = op.score_pending(headlines, scores, "vader", lexicon=lexicon(spark))
    assert [(row.headline_id, row.label) for row in pending.collect()] == [("1", "negative")]
    assert pending.columns == scores.columns
