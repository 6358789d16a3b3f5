"""The lexicon scorer against a plain, sequential reading of the published rules."""

import math
import string

import pytest
from frames import rows

from tidewire import operators as op
from tidewire.functions.valence import BOOSTERS_DOWN, BOOSTERS_UP, IDIOMS, NEGATIONS, ValenceRules
from tidewire.schemas import LEXICON
from tidewire.session import local_frame

WORDS = {
    "best": 3.0, "amazing": 3.0, "fantastic": 2.5, "wonderful": 2.5, "great": 3.0, "success": 2.5, "good": 1.9,
    "terrible": -2.0, "awful": -2.0, "disaster": -3.0, "horrible": -2.5, "failure": -2.5, "bad": -2.5, "kind": 2.4,
    "bomb": -2.2, "death": -2.9, "ass": -2.5, ":)": 2.0, "don't": -0.5, "so": 0.7, "right": 0.8, "least": 0.4,
}
MARKS = [".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?"]


def words_of(text):
    bare = text.translate(str.maketrans("", "", string.punctuation)).split()
    bare = {word for word in bare if len(word) > 1}
    found = [piece for piece in text.split() if len(piece) > 1]
    out = []
    for piece in found:
        for mark in MARKS:
            if piece.startswith(mark) and piece[len(mark):] in bare:
                piece = piece[len(mark):]
                break
            if piece.endswith(mark) and piece[:-len(mark)] in bare:
                piece = piece[:-len(mark)]
                break
        out.append(piece)
    return out


def by_hand(text, lexicon):
    words = words_of(text or "")
    loud_words = sum(word.isupper() for word in words)
    mixed = 0 < len(words) - loud_words < len(words)
    boosters = {**dict.fromkeys(BOOSTERS_UP, 0.293), **dict.fromkeys(BOOSTERS_DOWN, -0.293)}
    pairs = {"just enough", "kind of", "sort of"}

    def negates(word):
        return word.lower() in NEGATIONS or "n't" in word.lower()

    def booster(word, value):
        if word.lower() not in boosters:
            return 0.0
        size = boosters[word.lower()] * (-1 if value < 0 else 1)
        if word.isupper() and mixed:
            size += 0.733 if value > 0 else -0.733
        return size

    values = []
    for word in words:
        i, low = words.index(word), word.lower()
        of_kind = low == "kind" and i + 1 < len(words) and words[i + 1].lower() == "of"
        value = 0.0
        if not of_kind and low not in boosters and low in lexicon:
            value = lexicon[low]
            if word.isupper() and mixed:
                value += 0.733 if value > 0 else -0.733
            for k in (1, 2, 3):
                if i < k or words[i - k].lower() in lexicon:
                    continue
                value += booster(words[i - k], value) * {1: 1.0, 2: 0.95, 3: 0.9}[k]
                if k == 1:
                    value *= -0.74 if negates(words[i - 1]) else 1
                if k == 2:
                    if words[i - 2] == "never" and words[i - 1] in ("so", "this"):
                        value *= 1.5
                    elif negates(words[i - 2]):
                        value *= -0.74
                if k == 3:
                    if (words[i - 3] == "never" and words[i - 2] in ("so", "this")) or words[i - 1] in ("so", "this"):
                        value *= 1.25
                    elif negates(words[i - 3]):
                        value *= -0.74
                    back = lambda *places: " ".join(words[i + place] for place in places)
                    for phrase in (back(-1, 0), back(-2, -1, 0), back(-2, -1), back(-3, -2, -1), back(-3, -2)):
                        if phrase in IDIOMS:
                            value = IDIOMS[phrase]
                            break
                    if i + 1 < len(words) and back(0, 1) in IDIOMS:
                        value = IDIOMS[back(0, 1)]
                    if i + 2 < len(words) and back(0, 1, 2) in IDIOMS:
                        value = IDIOMS[back(0, 1, 2)]
                    if {back(-3, -2), back(-2, -1)} & (pairs | set(boosters)):
                        value -= 0.293
            if i > 0 and words[i - 1].lower() == "least" and "least" not in lexicon:
                if i == 1 or words[i - 2].lower() not in ("at", "very"):
                    value *= -0.74
        values.append(value)
    lows = [word.lower() for word in words]
    if "but" in lows:
        at = lows.index("but")
        values = [v * (0.5 if n < at else 1.5 if n > at else 1) for n, v in enumerate(values)]
    if not values:
        return 0.0, 0.0
    total = sum(values)
    asks = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0 if asks <= 1 else asks * 0.18 if asks <= 3 else 0.96)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    up = sum(v + 1 for v in values if v > 0)
    down = sum(1 - v for v in values if v < 0)
    flat = sum(v == 0 for v in values)
    up, down = (up + emphasis, down) if up > down else (up, down + emphasis) if up < down else (up, down)
    mass = up + down + flat
    return round(total / math.sqrt(total * total + 15), 4), max(round(part / mass, 3) for part in (up, down, flat))


TEXTS = [
    "a great harbour with good boats", "bad weather and a horrible crossing",
    "ferries leave twice each hour", "", None, "a", "!!! ... ?", "great", "GREAT", "GREAT STUFF", "it is GREAT stuff",
    "very good", "VERY good stuff", "VERY bad stuff", "really, very good", "slightly bad", "it was hardly ever good",
    "not good", "NOT good at all", "isn't good", "isn't really that good", "never so good", "never this bad",
    "it was so very good", "we think this is good", "never really so good ever", "was never all that good",
    "good but bad", "good stuff but BAD ending but fine good", "But good", "the good, the bad.", "\"great\" 'great' great's",
    "!great great! !!great great!! great!!!! (great) great?!? great-ish", "good! bad!! fine???", "good?? bad?", "good???? sure",
    "it's kind of good", "kind of a kind man", "they are a kind people", "it was sort of bad", "just enough good food",
    "this one is the bomb today", "what a bad ass car", "oh yeah right now", "it was a kiss of death for us",
    "death was near", "the least good", "at least good", "very least good", "LEAST good", "least good thing",
    "good good good not good", "not good and then good good", "so good so bad", "He is :) today", "I don't care, don't good",
    "great success here　now", "naïve ÉTÉ good", "très GOOD été", "tabs\tand\nlines\r\ngood\x1cbad", "ünter GOOD",
    "extremely extremely extremely good", "less than good, almost bad", "without any success", "no-one: good;bad good;",
    "good " * 200, "not " * 50 + "good", "nothing despite good", "?! good ?!", "goodé bad_", "ß STRASSE good",
]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("without", [(), ("least", "so", "right")])
def test_rules(spark, broadcast, without):
    words = {word: value for word, value in WORDS.items() if word not in without}
    texts = local_frame(spark, [(str(n), text) for n, text in enumerate(TEXTS)], "headline_id string, title string")
    lexicon = local_frame(spark, list(words.items()), LEXICON)
    got = {row.headline_id: row for row in op.lexicon_score(texts, lexicon, broadcast=broadcast).collect()}
    assert len(got) == len(TEXTS)
    wrong = []
    for n, text in enumerate(TEXTS):
        row, (score, confidence) = got[str(n)], by_hand(text, words)
        # A tie at the last place may round to either side.
        if abs(row.score - score) > 1e-9 or abs(row.confidence - confidence) > 1.001e-3:
            wrong.append((text, (row.score, row.confidence), (score, confidence)))
    assert not wrong
    assert {row.model for row in got.values()} == {"vader"}
    assert got["0"].score > 0 > got["1"].score and got["2"].label == "neutral"
    assert (got["3"].label, got["3"].score, got["3"].confidence) == ("neutral", 0.0, 0.0)


def test_direction_of_every_word_list(spark):
    """Every booster and negation does what it should to a good word."""
    texts = [(word, f"we saw {word} good things") for word in (*BOOSTERS_UP, *BOOSTERS_DOWN, *NEGATIONS)]
    frame = local_frame(spark, texts, "headline_id string, title string")
    lexicon = local_frame(spark, [("good", 1.9)], LEXICON)
    plain = by_hand("we saw some good things", {"good": 1.9})[0]
    for word, score in rows(op.lexicon_score(frame, lexicon).select("headline_id", "score")):
        # A word that also intensifies ("so", "this") acts in two ways, but still upwards.
        assert score < 0 if word in NEGATIONS else score > plain if word in BOOSTERS_UP else score < plain, word


def test_own_word_lists(spark):
    rules = ValenceRules(boosters_up=("tres",), boosters_down=("peu",), booster_pairs=(), negations=("pas",), idioms=())
    texts = [("1", "voila pas bon"), ("2", "voila tres bon"), ("3", "voila bon"), ("4", "voila peu bon"), ("5", "not bon")]
    frame = local_frame(spark, texts, "headline_id string, title string")
    scores = dict(rows(op.lexicon_score(frame, local_frame(spark, [("bon", 2.0)], LEXICON), rules).select("headline_id", "score")))
    assert scores["1"] < 0 < scores["4"] < scores["3"] < scores["2"] and scores["5"] == scores["3"]


def test_rows_that_share_a_key_are_scored_each(spark):
    frame = local_frame(spark, [("1", "it is not good stuff"), ("1", "it is not good stuff"), ("1", "good"), ("2", "good")], "headline_id string, title string")
    lexicon = local_frame(spark, [("good", 1.9), ("stuff", 0.1)], LEXICON)
    got = [rows(op.lexicon_score(frame, lexicon, broadcast=b).select("headline_id", "score")) for b in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 4
    assert got[0][0] == got[0][1] and got[0][2][1] == got[0][3][1]


def test_no_array_of_tokens_passes_the_explode(spark):
    frame = local_frame(spark, [("1", "good")], "headline_id string, title string")
    scored = op.lexicon_score(frame, local_frame(spark, [("good", 2.0)], LEXICON))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "tokens#" not in above.replace("n_tokens#", "") and "entries#" not in above


def test_texts_are_partitioned_once(spark):
    frame = local_frame(spark, [("1", "good")], "headline_id string, title string")
    scored = op.lexicon_score(frame, local_frame(spark, [("good", 2.0)], LEXICON))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(headline_id") == 1
    assert "partial_sum(value" in plan and "Window" not in plan and "SortMergeJoin" not in plan
