"""Text analyzers: columns from texts to lexemes.

``simple`` lower-cases and takes runs of ASCII letters and digits. ``english``
also drops stop words and stems by Porter's published rules (1980).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def simple_lexemes(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS or (word[i] == "y" and i > 0 and not _is_vowel(word, i - 1))


def _measure(stem: str) -> int:
    shape = "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", shape))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _is_vowel(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return (
        n > 2
        and not _is_vowel(word, n - 1)
        and _is_vowel(word, n - 2)
        and not _is_vowel(word, n - 3)
        and word[-1] not in "wxy"
    )


#: Suffix rules of the stemmer's second, third and fourth steps.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replaced(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def porter_stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if _measure(word) > 1 and _doubled(word) and word.endswith("l"):
        word = word[:-1]
    return word


def english_lexemes(text: Column) -> Column:
    """Stems of the words that are no stop words; an Arrow UDF with a memory."""
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        memory: dict[str, str] = {}

        def stem(word: str) -> str:
            if word not in memory:
                memory[word] = porter_stem(word)
            return memory[word]

        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws if w not in stop])

    return stems(simple_lexemes(text))


ANALYZERS = {"simple": simple_lexemes, "english": english_lexemes}


def lexemes_of(text: str, analyzer: str = "simple") -> list[str]:
    """The lexemes of one text, a query for instance, without a job."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {sorted(ANALYZERS)}, not {analyzer!r}")
    words = re.findall("[a-z0-9]+", text.lower())
    if analyzer == "simple":
        return words
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    return [porter_stem(w) for w in words if w not in stop]


def lexemes(text: Column, analyzer: str = "simple") -> Column:
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {sorted(ANALYZERS)}, not {analyzer!r}")
    return ANALYZERS[analyzer](text)
