"""Quality rules with cross-document line frequency, in DataFrame functions only.

Normalised lines (white space stripped, A-Z lower-cased) are hashed, and the distinct documents that
hold a line are counted per host. A line above the limit of its host is boilerplate; a document whose
words are mostly boilerplate is depleted and rejected, besides those that fail the rules on its own text.

Documents are counted by their content: copies of a text are one document, so that a text isn't
rejected for having been copied, and a third of all rows being copies of one text costs no more than
one row per task after the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs outside ``[\\x20\\x09-\\x0D]``."""
    return F.filter(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), lambda w: w != "")


def repeated_words(tokens: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that the text holds twice or more."""
    def windows(w: Column) -> Column:
        return F.transform(
            F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:  # of windows equal to a neighbour in sorted order
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:  # each start adds what its predecessor doesn't cover
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")), lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")))["n"]

    return let(let(F.sort_array(let(tokens, windows)), starts), covered)


def text_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``doc_id, host, hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"),
        F.xxhash64(text).alias("hash"), text.alias("text"))
    with_lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, _SPACE, "") != "")
    return base.select(
        "doc_id", "host", "hash",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(with_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id", "host", "hash", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        ((F.col("w.n_words") < min_words) | (100 * F.col("w.n_repeat_words") > max_repeat_percent * F.col("w.n_words"))).alias("base_failed"))


def line_table(docs: DataFrame) -> DataFrame:
    """``host, hash, line, words``: words of each distinct normalised line of each distinct text of a host."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("source").cast("string").alias("host"), F.xxhash64(text).alias("hash"), F.explode(F.split(text, "\n")).alias("line"))
    n_words = F.size(words(F.col("line")))
    # repeated lines of a text add up; copies of a text don't
    normal = F.translate(F.btrim("line", F.lit(_SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = split.select("host", "hash", F.xxhash64(normal).alias("line"), n_words.alias("words")).where("words > 0")
    return lines.groupBy("host", "hash", "line").agg(F.max("words").alias("words"))


def frequent_lines(lines: DataFrame, min_docs: int = 20, max_percent: float = 1) -> DataFrame:
    """``host, line`` of the lines that at least ``min_docs`` distinct texts of a host, and more than ``max_percent`` of them, hold."""
    hosts = lines.groupBy("host", "hash").agg(F.sum("words").alias("all_words")).groupBy("host").agg(F.count("*").alias("host_texts"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    joined = counts.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")))
    return joined.where(F.col("n") * 100 > F.col("host_texts") * max_percent).select("host", "line")


def depleted_texts(docs: DataFrame, min_docs: int = 20, max_percent: float = 1, min_kept_percent: int = 30) -> DataFrame:
    """``host, hash, removed_words`` of texts that keep under ``min_kept_percent`` of their words when `frequent_lines` are removed.

    The share is small, so that boilerplate reaches it on hosts of any size: a line of one text in a hundred is no one's own. Each line
    counts once per text, and copies of a text are one text.
    """
    lines = materialize(line_table(docs), "lines")
    texts = lines.groupBy("host", "hash").agg(F.sum("words").alias("all_words"))
    frequent = frequent_lines(lines, min_docs, max_percent).toDF("_h", "_line")
    held = lines.join(frequent, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_line")))
    removed = held.groupBy("host", "hash").agg(F.sum("words").alias("removed_words"))
    both = removed.toDF("_h", "_hash", "removed_words").join(texts, F.col("_h").eqNullSafe(F.col("host")) & (F.col("_hash") == F.col("hash")))
    return both.where((F.col("all_words") - F.col("removed_words")) * 100 < F.col("all_words") * min_kept_percent).select("host", "hash", "removed_words")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """The columns of `text_rules`, and ``kept``, for every row of ``docs`` (doc_id, source, text).

    Null and empty texts have no words and fail. A null source is a host of its own. Rows that repeat
    a doc_id are judged each by its own text. Other columns are ignored.
    """
    gone = depleted_texts(docs, **limits).select(F.col("host").alias("_h"), F.col("hash").alias("_hash"), F.lit(True).alias("_gone"))
    rules = text_rules(docs)
    joined = rules.join(gone, F.col("host").eqNullSafe(F.col("_h")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select(*rules.columns, (~F.col("base_failed") & F.col("_gone").isNull()).alias("kept"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """Rows of ``docs`` that `quality_rules` keeps, with all their columns."""
    failed = text_rules(docs).where("base_failed").select("host", "hash")
    bad = depleted_texts(docs, **limits).select("host", "hash").union(failed).distinct().toDF("bad_host", "bad_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("host"), F.xxhash64(text).alias("hash"))
    on = F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("hash") == F.col("bad_hash"))
    return rows.join(bad, on, "left_anti").select("row.*")
