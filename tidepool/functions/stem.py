"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), for the distinct words of a corpus and not for each occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the paper's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes: list[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past tense and participles
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        ending = _longest(word, ["ed", "ing"])
        if ending and "v" in _shape(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")) or (not _double(word) and _measure(word) == 1 and _short(word)):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        ending = _longest(word, list(table))
        if ending and _measure(word[: -len(ending)]):
            word = word[: -len(ending)] + table[ending]
    ending = _longest(word, STEP_4)
    if ending:
        left = word[: -len(ending)]
        if _measure(left) > 1 and (ending != "ion" or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem(word: Column) -> Column:
    def run(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for w in words:
            yield w.map(porter)

    run.__annotations__ = {"words": Iterator[pd.Series], "return": Iterator[pd.Series]}  # the module's are kept as text
    return F.pandas_udf(run, "string")(word)
