"""The published Porter2 ("English" Snowball) stemming rules for one word.

Kept free of Spark on purpose: it is the small per-word helper behind
:func:`threadmine.functions.stem.stem_words`, which applies it once per distinct
word of an Arrow batch.
"""

from __future__ import annotations

import re

# Fixed values of the published algorithm.
INVARIANT_OR_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL_AFTER_STEP_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
APOSTROPHES = {"'s'", "'s", "'"}
LONG_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous",
    "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able",
    "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ative": "", "ical": "ic", "ness": "", "ful": "",
}
STEP_4 = {
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion", "al", "er", "ic",
}
STEP_1B = {"eed", "eedly", "ed", "edly", "ing", "ingly"}

_NEXT_REGION = re.compile(r"[aeiouy][^aeiouy]")
_Y_AS_CONSONANT = re.compile(r"(^|[aeiouy])y")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE_END = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    """Index just behind the first non-vowel that follows a vowel, from ``start``."""
    hit = _NEXT_REGION.search(word, start)
    return hit.end() if hit else len(word)


def _longest(word: str, suffixes, longest: int) -> str:
    """The longest suffix of ``word`` that is among ``suffixes``, or ""."""
    for n in range(longest, 0, -1):
        tail = word[-n:]
        if tail in suffixes:
            return tail
    return ""


def stem_word(word: str) -> str:
    """Stem of one lower-case word; words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word in INVARIANT_OR_IRREGULAR:
        return INVARIANT_OR_IRREGULAR[word]
    w = word.removeprefix("'")
    w = _Y_AS_CONSONANT.sub(r"\1Y", w)
    prefix = next((p for p in LONG_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(w, 0)
    r2 = _after(w, r1)

    tail = _longest(w, APOSTROPHES, 3)
    if tail:
        w = w[: -len(tail)]

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w, 0, len(w) - 2):
        w = w[:-1]
    if w in FINAL_AFTER_STEP_1A:
        return w

    tail = _longest(w, STEP_1B, 5)
    if tail in ("eed", "eedly"):
        if len(w) - len(tail) >= r1:
            w = w[: -len(tail)] + "ee"
    elif tail and _VOWEL.search(w, 0, len(w) - len(tail)):
        w = w[: -len(tail)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE_END.search(w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    tail = _longest(w, STEP_2, 7)
    if tail and len(w) - len(tail) >= r1:
        before = w[: -len(tail)]
        if not (tail == "ogi" and not before.endswith("l")) and not (
            tail == "li" and (not before or before[-1] not in "cdeghkmnrt")
        ):
            w = before + STEP_2[tail]

    tail = _longest(w, STEP_3, 7)
    if tail and len(w) - len(tail) >= r1 and (tail != "ative" or len(w) - len(tail) >= r2):
        w = w[: -len(tail)] + STEP_3[tail]

    tail = _longest(w, STEP_4, 5)
    if tail and len(w) - len(tail) >= r2:
        if tail != "ion" or w[: -len(tail)].endswith(("s", "t")):
            w = w[: -len(tail)]

    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
