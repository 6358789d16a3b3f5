"""Scorer registry, model scorers, probability folding, and the incremental scoring step."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCORES
from ..session import materialize
from .keyed import insert_if_absent, scoring_backlog
from .lexicon import lexicon_score

log = logging.getLogger(__name__)

Predict = Callable[[list[str]], Iterable[Iterable[tuple[str, float]]]]
Scorer = Callable[..., DataFrame]

LEXICON_BACKEND = "vader"  # fixed value
SCORE_COLUMNS = [field.name for field in SCORES]
#: Bytes of text that a model is given at once (a longer text goes alone).
PART_BYTES = 4_000_000

_backends: dict[str, Scorer] = {}


def register_backend(name: str, scorer: Scorer) -> None:
    """Adds a scorer: ``scorer(headlines, **options)`` -> headline_id, label, score, confidence, model."""
    _backends[name] = scorer


def fold_probabilities(rows: DataFrame, probs: str = "probs") -> DataFrame:
    """Class probabilities (map of class to share) to label, score, confidence.

    Class names are lower-cased; the score is P(positive) - P(negative), a missing class counts
    as 0; the label is the likeliest class, the first one on ties. An empty or NULL map gives
    NULLs, which marks the row for the fallback scorer.
    """
    entries = F.transform(
        F.map_entries(probs), lambda entry: F.struct(F.lower(entry["key"]).alias("key"), entry["value"].alias("value"))
    )
    # Names that fall together when lower-cased keep the last value, at the place of the first.
    by_name = F.transform(
        F.array_distinct(F.transform(entries, lambda entry: entry["key"])),
        lambda name: F.struct(
            name.alias("key"),
            F.element_at(F.filter(entries, lambda entry: entry["key"] == name), -1)["value"].alias("value"),
        ),
    )
    rows = rows.withColumn("_classes", by_name)

    def share(name: str):
        return F.coalesce(F.get(F.filter("_classes", lambda entry: entry["key"] == name), F.lit(0))["value"], F.lit(0.0))

    best = F.array_max(F.transform("_classes", lambda entry: entry["value"]))
    usable = F.size("_classes") > 0
    return rows.withColumn("confidence", best).withColumns({
        "label": F.get(F.filter("_classes", lambda entry: entry["value"] == F.col("confidence")), F.lit(0))["key"],
        "score": F.when(usable, share("positive") - share("negative")),
    }).drop("_classes")


def _each(predict: Predict, texts: list[str]) -> list[dict | None]:
    """Results of a model; a batch that fails is split until only the texts that fail have none."""
    try:
        results = [dict(classes) for classes in predict(texts)]
        if len(results) != len(texts):
            raise ValueError("a model must return one result per text")
        return results
    except Exception:  # any failure of a model sends its text to the fallback
        if len(texts) <= 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return _each(predict, texts[:half]) + _each(predict, texts[half:])


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``size`` bytes of titles, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("title")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _classify(load: Callable[[], Predict], part_bytes: int):
    """Texts through a model that is loaded once per task; those that it fails on have NULL results, and only they keep their titles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            predict = load()
        except Exception:  # no model on this worker: its rows go to the fallback
            log.exception("the model can't be loaded; all texts of the task go to the fallback")
            predict = None
        for batch in (part for whole in batches for part in _parts(whole, part_bytes)):
            titles = batch.column("title").to_pylist()
            results = [None] * len(titles) if predict is None else _each(predict, [title or "" for title in titles])
            failed = sum(result is None for result in results)
            if failed and predict is not None:
                log.warning("the model failed on %d of %d texts; they go to the fallback", failed, len(titles))
            probs = pa.array([None if x is None else list(x.items()) for x in results], pa.map_(pa.string(), pa.float64()))
            kept = pa.array([None if x else title for x, title in zip(results, titles)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("headline_id"), kept, probs], ["headline_id", "title", "probs"])

    return run


def model_score(
    headlines: DataFrame, load: Callable[[], Predict], model: str, lexicon: DataFrame, profile=None, **lexicon_options
) -> DataFrame:
    """Scores with a classifier, and with the lexicon where it failed on a text.

    ``load()`` runs on the executors and returns ``predict(texts)``, one list of
    (class, probability) per text. A batch that fails is split until only failing texts are left, so
    that results don't depend on how texts are batched; it is given `PART_BYTES` of text at once, whatever Spark's batches hold. The model's results are written once, in a stage without a shuffle that can have
    executors of its own (``profile``, a Spark resource profile, such as one with GPUs); only the texts that it failed on are read again, for the
    lexicon. Failures are logged; fallback rows carry the lexicon's model name, by which they
    can be counted.
    """
    texts = headlines.select(F.col("headline_id").cast("string").alias("headline_id"), F.col("title").cast("string").alias("title"))
    classified = texts.mapInArrow(_classify(load, PART_BYTES), "headline_id string, title string, probs map<string, double>", profile=profile)
    failed = F.col("score").isNull()
    written = materialize(
        fold_probabilities(classified).select("headline_id", "label", "score", "confidence", F.when(failed, F.col("title")).alias("title")), "model-scores"
    )
    scored = written.where(~failed).select("headline_id", "label", "score", "confidence", F.lit(model).alias("model"))
    fallback = lexicon_score(written.where(failed).select("headline_id", "title"), lexicon, **lexicon_options)
    return scored.unionByName(fallback.select(scored.columns))


def score(headlines: DataFrame, backend: str | None = None, **options) -> DataFrame:
    """Scores headlines (headline_id, title) with a named backend.

    Without a name, a registered model scorer is preferred over the lexicon.
    """
    name = backend or next((name for name in _backends if name != LEXICON_BACKEND), LEXICON_BACKEND)
    if name not in _backends:
        raise ValueError(f"unknown scoring backend {name!r}; known: {sorted(_backends)}")
    return _backends[name](headlines, **options).select(*SCORE_COLUMNS)


def score_pending(headlines: DataFrame, scores: DataFrame, backend: str | None = None, **options) -> DataFrame:
    """Score rows to append: the backlog, scored; a headline that has a score keeps it.

    The backlog excludes scored headlines. Ids must tell its rows apart (`key_id` of the key columns in
    use); rows that repeat an id are scored each by their own text.
    """
    return score(scoring_backlog(headlines, scores), backend, **options)


def new_scores(batch: DataFrame, scores: DataFrame, order: Iterable[str]) -> DataFrame:
    """Score rows from elsewhere: the first per headline, unless it has one already."""
    return insert_if_absent(batch, scores, ("headline_id",), order)


register_backend(LEXICON_BACKEND, lexicon_score)
