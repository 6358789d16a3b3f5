"""Fixed values of the public rule-based valence scorer (Hutto & Gilbert, 2014)."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists and weights of the published rule set, as text, in natural order.
BOOSTERS_UP = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely
especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin
fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly
purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably
unusually utterly very
""".split()
BOOSTERS_DOWN = """
almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely
slightly somewhat sorta sortof sort-of
""".split()
BOOSTER_PAIRS = ["just enough", "kind of", "sort of"]
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't
doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't
mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt
uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't
wouldn't rarely seldom despite
""".split()
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_FACTOR = -0.74
DISTANCE_WEIGHTS = (1.0, 0.95, 0.9)
NORMALIZER = 15.0
EXCLAMATION_WEIGHT, EXCLAMATION_MAX = 0.292, 4
QUESTION_WEIGHT, QUESTION_MAX, QUESTION_CEILING = 0.18, 3, 0.96
BUT_BEFORE, BUT_AFTER = 0.5, 1.5


@dataclass(frozen=True)
class ValenceRules:
    """Word lists of the scorer; the defaults are the published ones for English."""

    boosters_up: tuple[str, ...] = tuple(BOOSTERS_UP)
    boosters_down: tuple[str, ...] = tuple(BOOSTERS_DOWN)
    booster_pairs: tuple[str, ...] = tuple(BOOSTER_PAIRS)
    negations: tuple[str, ...] = tuple(NEGATIONS)
    idioms: tuple[tuple[str, float], ...] = tuple(IDIOMS.items())
