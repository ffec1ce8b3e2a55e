"""Stems by the published suffix-stripping algorithm of M. F. Porter (1980), for words of a-z."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The algorithm's suffixes and what replaces them, by step; the longest that fits is looked at.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """``c`` and ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How many times a run of vowels is followed by a run of consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words with other characters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    plural = _longest(word, ("sses", "ies", "ss", "s"))
    if plural in ("sses", "ies"):
        word = word[:-2]
    elif plural == "s":
        word = word[:-1]
    past = _longest(word, ("eed", "ed", "ing"))
    if past == "eed":
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif past and "v" in _shape(word[: -len(past)]):
        word = word[: -len(past)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP2, STEP3):
        end = _longest(word, step)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + step[end]
    end = _longest(word, STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def porter(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of a column of distinct words."""
    for batch in words:
        yield batch.map(lambda w: None if w is None else stem(w))
