"""The English (Porter2) stemmer, written from the published definition of the algorithm.

The word lists below are fixed values of that definition. :func:`stem_column` applies it
as an Arrow UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words with a stem of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes", "dying": "die", "lying": "lie", "tying": "tie",
}
# Words that stay as they are after step 1a.
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Beginnings after which R1 starts.
R1_STARTS = ("gener", "commun", "arsen")
# Suffix to replacement, in R1, longest suffix first; None marks rules with a condition.
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": None, "li": None,
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": None, "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
LI_BEFORE = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}](.*)", re.S)
_SHORT = re.compile(f"(?:^[{_V}][^{_V}]|.*[^{_V}][{_V}][^{_V}wxY])$", re.S)
_HAS_VOWEL = re.compile(f"[{_V}]")


def _after(word: str, start: int) -> int:
    """Where the region behind the first non-vowel after a vowel starts."""
    m = _REGION.search(word, start)
    return m.start(1) if m else len(word)


def _ends(word: str, suffixes) -> str | None:
    return next((s for s in suffixes if word.endswith(s)), None)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(f"(^|[{_V}])y", r"\1Y", word)
    start = next((s for s in R1_STARTS if word.startswith(s)), "")
    r1 = len(start) or _after(word, 0)
    r2 = _after(word, r1)

    # Step 0
    if s := _ends(word, ("'s'", "'s", "'")):
        word = word[: -len(s)]
    # Step 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif not word.endswith(("us", "ss")) and word.endswith("s") and _HAS_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    # Step 1b
    if s := _ends(word, ("eedly", "eed")):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif (s := _ends(word, ("ingly", "edly", "ing", "ed"))) and _HAS_VOWEL.search(word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.match(word):
            word += "e"
    # Step 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # Step 2
    if (s := _ends(word, STEP2)) and len(word) - len(s) >= r1:
        base, new = word[: -len(s)], STEP2[s]
        if new is not None:
            word = base + new
        elif s == "ogi":
            word = word[:-1] if base.endswith("l") else word
        elif base and base[-1] in LI_BEFORE:
            word = base
    # Step 3
    if (s := _ends(word, STEP3)) and len(word) - len(s) >= r1:
        if STEP3[s] is not None:
            word = word[: -len(s)] + STEP3[s]
        elif len(word) - len(s) >= r2:
            word = word[: -len(s)]
    # Step 4
    if (s := _ends(word, STEP4)) and len(word) - len(s) >= r2 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    # Step 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT.match(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


#: Stems a worker remembers; beyond it the memory starts anew.
_REMEMBERED = 500_000
_known: dict[str, str] = {}


def stem_all(words: list[str]) -> list[str]:
    """The stems of distinct words; those a worker has met before aren't stemmed again."""
    if len(_known) > _REMEMBERED:
        _known.clear()
    for w in words:
        if w not in _known:
            _known[w] = stem(w)
    return [_known[w] for w in words]


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """Null stays null. Each distinct word is stemmed once a worker, not once a row."""
    distinct = words.dropna().unique().tolist()
    return words.map(dict(zip(distinct, stem_all(distinct))), na_action="ignore")
