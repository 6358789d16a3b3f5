"""Lexicon scorer as a Spark job.

Text is cut into tokens, tokens are exploded with the words around them and looked up in the lexicon, and
each hit is adjusted by those words; the values are then summed per word and per headline. The lookups are joins, the adjustments plain expressions on the row, and one shuffle of the hits serves all sums. No row
holds more than six words after the explode, so the work grows with the number of tokens, however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of
from ..functions.valence import (
    BOOST,
    BUT_AFTER,
    BUT_BEFORE,
    CAPS_BOOST,
    DISTANCE_WEIGHTS,
    EXCLAMATION_MAX,
    EXCLAMATION_WEIGHT,
    NEGATION_FACTOR,
    NORMALIZER,
    QUESTION_CEILING,
    QUESTION_MAX,
    QUESTION_WEIGHT,
    ValenceRules,
)
from .keyed import fits_broadcast

MODEL_NAME = "vader"  # fixed value

# A token is a run of two or more non-blank characters, less one punctuation mark (or a listed run
# of them) before or after it when all the rest is free of punctuation. Matches follow each other
# through the text and never start inside a token, so the text is read once; the classes list single
# characters, which the matcher looks up in a table.
_CHAR = r"[^\s\x1c\x1d\x1e\x1f]"
_WORD = r"[^\s\x1c\x1d\x1e\x1f!\"#$%&'()*+,\-./:;<=>?@\[\\\]\^_`{|}~]{2,}+"
_MARK = r"(?:[.!?,;:\-'\"]|!!|!!!|\?\?|\?\?\?|\?!\?|!\?!|\?!\?!|!\?!\?)"
_TOKEN = (
    rf"(?U)(?:(?=[.!?,;:\-'\"]){_MARK}(?={_WORD}(?!{_CHAR})))?+"
    rf"((?:{_WORD}(?={_MARK}?(?!{_CHAR})))|{_CHAR}{{2,}}+){_CHAR}*+"
)
_BACK = (1, 2, 3)

# Tells rows apart that share a key.
ROW = "_row"


def lexicon_score(
    headlines: DataFrame,
    lexicon: DataFrame,
    rules: ValenceRules = ValenceRules(),
    key: str = "headline_id",
    text: str = "title",
    keep: tuple[str, ...] = (),
    broadcast: bool | None = None,
) -> DataFrame:
    """Scores texts with a lexicon (token, valence): key, label, score, confidence, model.

    ``lexicon`` has lower-case tokens, one row each. It is broadcast after its size was measured;
    beyond the bound the lookups are shuffle joins, whose frequent words AQE splits (``broadcast``
    overrides the choice). ``keep`` names columns that pass through. Every row is scored by its own
    text, also if rows share a key.
    """
    tokens = _tokenize(headlines, key, text, keep)
    lexicon = lexicon.groupBy("token").agg(F.max("valence").alias("valence"))
    if broadcast is None:
        broadcast = fits_broadcast(lexicon)
    hits = _around(_hits(_look_up(_explode(tokens), lexicon, F.lower("item"), "base", broadcast)), rules)
    for k in _BACK:
        hits = _look_up(hits, lexicon, _near(k)["plain"], f"valence{k}", broadcast)
    hits = hits.withColumns({f"known{k}": F.col(f"valence{k}").isNotNull() for k in _BACK})
    return _fold(_valued(hits, rules), [key, *keep, ROW]).drop(ROW)


def _tokenize(headlines: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Per text: its tokens, and what depends on the text as a whole."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = headlines.select(key, *keep, F.monotonically_increasing_id().alias(ROW), whole.alias("whole"))
    texts = texts.withColumn("tokens", F.regexp_extract_all("whole", F.lit(_TOKEN), F.lit(1)))
    caps = F.size(F.filter("tokens", _is_upper))
    # First "but", counted from 1; 0 where there is none.
    but_at = F.when(
        F.lower("whole").contains("but"),
        F.array_position(F.transform("tokens", F.lower), "but"),
    ).otherwise(0)

    def count_of(mark: str) -> Column:
        return F.length("whole") - F.length(F.replace("whole", F.lit(mark), F.lit("")))

    return texts.select(
        key,
        *keep,
        ROW,
        "tokens",
        ((caps > 0) & (caps < F.size("tokens"))).alias("mixed_caps"),
        but_at.cast("int").alias("but_at"),
        F.size("tokens").alias("n_tokens"),
        count_of("!").alias("bangs"),
        count_of("?").alias("questions"),
    )


def _explode(texts: DataFrame) -> DataFrame:
    """One row per token, with the words around it; texts without tokens keep one row."""
    def with_context(item: Column, pos: Column) -> Column:
        back = [F.get("tokens", pos - k).alias(f"back{k}") for k in _BACK]
        ahead = [F.get("tokens", pos + k).alias(f"next{k}") for k in (1, 2)]
        return F.struct(pos.alias("pos"), item.alias("item"), *back, *ahead)

    entries = texts.withColumn("entries", F.transform("tokens", with_context)).drop("tokens")
    return entries.withColumn("entry", F.explode_outer("entries")).select("*", "entry.*").drop("entries", "entry")


def _look_up(rows: DataFrame, lexicon: DataFrame, word: Column, name: str, broadcast: bool) -> DataFrame:
    """Adds the valence of a word, NULL where the lexicon lacks it."""
    entry = lexicon.select(F.col("token").alias("_token"), F.col("valence").alias(name))
    return rows.join(F.broadcast(entry) if broadcast else entry, word == F.col("_token"), "left").drop("_token")


def _hits(found: DataFrame) -> DataFrame:
    """Tokens with a value, and the first token of every text, so that no text is lost.

    The rest only counts as neutral, and the number of tokens is known.
    """
    return found.where(F.col("base").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))


def _around(hits: DataFrame, rules: ValenceRules) -> DataFrame:
    """Adds what the words around a hit do to it."""
    word = F.lower("item")
    of_kind = (word == "kind") & (F.lower(F.coalesce("next1", F.lit(""))) == "of")
    booster = word.isin(*rules.boosters_up, *rules.boosters_down, *rules.booster_pairs)
    # A function over an array is not compiled into its stage, so this also ends the stage that
    # reads every token: what follows is long code that would keep the token loop from being
    # compiled to machine code, and it is for hits only. All that depends on the words alone is
    # computed here, so that the stage after the lookups is short as well.
    words = F.array("back1", "back2", "back3")
    idiom, damped = _idioms(rules)
    item, base = F.col("item"), F.col("base")
    louder = F.when(base > 0, base + CAPS_BOOST).otherwise(base - CAPS_BOOST)
    start = F.when(_is_upper(item) & F.col("mixed_caps"), louder).otherwise(base)
    place, but = F.col("pos") + 1, F.col("but_at")
    return hits.withColumns({
        "around": F.transform(words, lambda word: _effect(word, rules)),
        "idiom": idiom,
        "damping": F.when(damped, BOOST).otherwise(0.0),
        "value": F.when(base.isNotNull() & ~booster & ~of_kind, start),
        "weight": F.when((but > 0) & (place < but), BUT_BEFORE)
        .when((but > 0) & (place > but), BUT_AFTER)
        .otherwise(1.0),
    })


def _effect(word: Column, rules: ValenceRules) -> Column:
    """What a word does to a hit after it: booster size along the hit, extra for capitals, negation."""
    plain = F.lower(word)
    size = F.when(plain.isin(*rules.boosters_up), BOOST).when(plain.isin(*rules.boosters_down), -BOOST)
    return F.struct(
        plain.alias("plain"),
        size.alias("size"),
        F.when(_is_upper(word) & F.col("mixed_caps"), CAPS_BOOST).otherwise(0.0).alias("loud"),
        F.when(plain.isin(*rules.negations) | plain.contains("n't"), NEGATION_FACTOR).otherwise(1.0).alias("factor"),
    )


def _is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _near(k: int) -> Column:
    """Effect of the k-th word before the hit."""
    return F.get("around", F.lit(k - 1))


def _boosted(value: Column, effect: Column, weight: float) -> Column:
    """A value after a booster word: moved along its own direction, further for capitals."""
    size, loud = effect["size"], effect["loud"]
    move = F.when(value > 0, size + loud).when(value < 0, -size - loud).otherwise(size - loud)
    return value + F.coalesce(move, F.lit(0.0)) * weight


def _valued(hits: DataFrame, rules: ValenceRules) -> DataFrame:
    """Adds ``value`` per token, before its weight: 0 unless it is a lexicon hit, else its adjusted valence.

    Every stage is a column of its own, since the next one reads it several times.
    """
    b1, b2, b3 = (F.col(f"back{k}") for k in _BACK)

    def intensifier(word: Column) -> Column:
        return word.isin("so", "this")

    factors = (
        _near(1)["factor"],
        F.when((b2 == "never") & intensifier(b1), 1.5).otherwise(_near(2)["factor"]),
        F.when(((b3 == "never") & intensifier(b2)) | intensifier(b1), 1.25).otherwise(_near(3)["factor"]),
    )
    for k in _BACK:
        # The k-th word back acts only if it is there and has no valence of its own.
        word, value = F.col(f"back{k}"), F.col("value")
        changed = _boosted(value, _near(k), DISTANCE_WEIGHTS[k - 1]) * factors[k - 1]
        if k == 3:
            changed = F.coalesce("idiom", changed) - F.col("damping")
        acts = word.isNotNull() & ~F.col(f"known{k}")
        hits = hits.withColumn("value", F.when(acts, changed).otherwise(value))

    kept_least = b2.isNotNull() & _near(2)["plain"].isin("at", "very")
    least = (_near(1)["plain"] == "least") & ~F.col("known1") & ~kept_least
    final = F.col("value") * F.when(least, NEGATION_FACTOR).otherwise(1.0)
    return hits.withColumn("value", F.coalesce(final, F.lit(0.0)))


def _idioms(rules: ValenceRules) -> tuple[Column, Column]:
    """Value of a set phrase around the hit (those that begin with it come first), and whether a
    booster of two words is before it."""
    b1, b2, b3 = (F.col(f"back{k}") for k in _BACK)
    item, n1, n2 = F.col("item"), F.col("next1"), F.col("next2")

    def phrase(*words: Column) -> Column:
        # NULL as soon as one of the words is missing.
        return F.concat(words[0], *[part for word in words[1:] for part in (F.lit(" "), word)])

    values = F.create_map(*[F.lit(part) for idiom in rules.idioms for part in idiom]).cast("map<string,double>")
    phrases = [
        phrase(item, n1, n2), phrase(item, n1),
        phrase(b1, item), phrase(b2, b1, item), phrase(b2, b1), phrase(b3, b2, b1), phrase(b3, b2),
    ]
    value = F.coalesce(*[F.try_element_at(values, words) for words in phrases])
    pairs = list(rules.booster_pairs)
    return value, phrase(b3, b2).isin(pairs) | phrase(b2, b1).isin(pairs)


def _fold(hits: DataFrame, ids: list[str]) -> DataFrame:
    """Sums per text, punctuation emphasis, normalized score and shares."""
    # A repeated word takes the value of its first occurrence; only the weights are of each place.
    # One shuffle, of the hits alone, serves both aggregates.
    words = hits.select(*ids, "item", "pos", "value", "weight", "n_tokens", "bangs", "questions").repartition(*ids).groupBy(*ids, "item").agg(
        F.min_by("value", "pos").alias("value"),
        F.sum("weight").alias("weight"),
        F.count(F.lit(1)).alias("times"),
        *[F.max(name).alias(name) for name in ("n_tokens", "bangs", "questions")],
    )
    value = F.col("value")
    words = words.withColumn("value", F.coalesce("value", F.lit(0.0)) * F.col("weight"))
    sums = words.groupBy(*ids).agg(
        F.sum("value").alias("total"),
        F.sum(F.when(value > 0, value + F.col("times")).otherwise(0.0)).alias("up"),
        F.sum(F.when(value < 0, value - F.col("times")).otherwise(0.0)).alias("down"),
        (F.max("n_tokens") - F.sum(F.when(value != 0, F.col("times")).otherwise(0))).alias("flat"),
        F.max("bangs").alias("bangs"),
        F.max("questions").alias("questions"),
    )
    questions = F.col("questions")
    emphasis = F.least("bangs", F.lit(EXCLAMATION_MAX)) * EXCLAMATION_WEIGHT + (
        F.when(questions <= 1, 0.0)
        .when(questions <= QUESTION_MAX, questions * QUESTION_WEIGHT)
        .otherwise(QUESTION_CEILING)
    )
    sums = sums.withColumn("emphasis", emphasis)
    total, up, down = F.col("total"), F.col("up"), F.col("down")
    sums = sums.select(
        *ids,
        "flat",
        (total + F.signum(total) * F.col("emphasis")).alias("total"),
        (up + F.when(up > -down, F.col("emphasis")).otherwise(0.0)).alias("up"),
        (-down + F.when(up < -down, F.col("emphasis")).otherwise(0.0)).alias("down"),
    )
    mass = up + down + F.col("flat")

    def share(part: Column) -> Column:
        return F.coalesce(F.bround(F.try_divide(part, mass), 3), F.lit(0.0))

    scored = sums.select(
        *ids,
        F.bround(total / F.sqrt(total * total + NORMALIZER), 4).alias("score"),
        F.greatest(share(up), share(F.col("flat")), share(down)).alias("confidence"),
    )
    return scored.select(
        *ids,
        label_of(F.col("score")).alias("label"),
        "score",
        "confidence",
        F.lit(MODEL_NAME).alias("model"),
    )
