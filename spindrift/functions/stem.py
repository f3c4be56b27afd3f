"""English stems of words (Porter2), and the words that full-text search leaves out."""

from __future__ import annotations

import re
from functools import lru_cache

#: The English stop words of the full-text search that rows are ranked by.
ENGLISH_STOPS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, words that stop after the plural, beginnings that are whole syllables.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
WHOLE = ("gener", "commun", "arsen")
#: Fixed values: (ending, what takes its place) of the second and third step, longest first; and the endings of the fourth.
SECOND = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VOWELS, LI_BEFORE = "aeiouy", "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_Y = re.compile("([aeiouy])y")
_PAST = re.compile("(?:edly|ingly|ed|ing)$")
_SHORT_END = re.compile("(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$")
_SHORT_START = re.compile("^[aeiouy][^aeiouy]$")


def _by_tail(step) -> dict[str, tuple]:
    """A step's endings by their last two letters, longest first."""
    tails = sorted({ending[-2:] for ending, *_ in step})
    return {t: tuple(x for x in step if x[0].endswith(t)) for t in tails}


_SECOND, _THIRD, _FOURTH = _by_tail(SECOND), _by_tail(THIRD), _by_tail([(ending, "") for ending in FOURTH])
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions R1 and R2 begin."""
    if word.startswith(WHOLE):
        first = next(len(p) for p in WHOLE if word.startswith(p))
    else:
        first = m.end() if (m := _REGION.search(word)) else len(word)
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _ends_short(word: str) -> bool:
    return bool(_SHORT_END.search(word) or _SHORT_START.search(word))


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    if not word.endswith(("ed", "ing", "ly")):
        return word
    if word.endswith(("eed", "eedly")):
        at = len(word) - (3 if word.endswith("eed") else 5)
        return word[: at + 2] if at >= first else word
    found = _PAST.search(word)
    if not found or not _VOWEL.search(word[: found.start()]):
        return word
    word = word[: found.start()]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(_DOUBLES):
        return word[:-1]
    return word + "e" if first >= len(word) and _ends_short(word) else word


def _replace(word: str, first: int, second: int) -> str:
    """The second, third and fourth step."""
    for ending, instead in _SECOND.get(word[-2:], ()):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= first and (ending != "ogi" or word[at - 1 : at] == "l") and (ending != "li" or word[at - 1 : at] in tuple(LI_BEFORE)):
                word = word[:at] + instead
            break
    for ending, instead in _THIRD.get(word[-2:], ()):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= (second if ending == "ative" else first):
                word = word[:at] + instead
            break
    for ending, _ in _FOURTH.get(word[-2:], ()):
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= second and (ending != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes; words of other alphabets keep their letters."""
    if len(word) < 3 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if "y" in word:
        word = _Y.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    first, second = _regions(word)
    word = _plural(word)
    if word in SETTLED:
        return word
    word = _past(word, first)
    if word[-1] in "yY" and len(word) > 2 and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _replace(word, first, second)
    if word.endswith("e"):
        if len(word) - 1 >= second or len(word) - 1 >= first and not _ends_short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()
