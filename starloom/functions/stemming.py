"""Porter stemming of index tokens, as a vectorised function with one stem for each distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Suffix tables of the published algorithm (fixed values).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, table) -> str | None:
    return max((s for s in table if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((len(s) for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := _longest(word, table)) and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    if (s := _longest(word, STEP4)) and _measure(base := word[: -len(s)]) > 1 and (s != "ion" or base[-1:] in ("s", "t")):
        word = base
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def of(w: str) -> str:
        if w not in known:
            known[w] = stem(w)
        return known[w]

    return words.map(lambda ws: None if ws is None else [of(w) for w in ws])
