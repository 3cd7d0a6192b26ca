"""English stems by the published Porter2 algorithm, over Arrow batches of word lists; no Spark function has them."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = "cdeghkmnrt"
WHOLE_PREFIXES = ("gener", "commun", "arsen")
KNOWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant behind a vowel begins, from ``start`` on."""
    found = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    rest = w[: -len(end)]
    if not re.search("[aeiouy]", rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(DOUBLES):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _short_end(rest) else rest


def _derived(w: str, r1: int, r2: int) -> str:
    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)][-1:]
        if (end != "ogi" or before == "l") and (end != "li" or before and before in LI_AFTER):
            w = w[: -len(end)] + STEP2[end]
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words with other letters than a to z are their own."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in KNOWN:
        return KNOWN[word]
    # a consonant y is written Y
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    whole = next((p for p in WHOLE_PREFIXES if w.startswith(p)), None)
    r1 = len(whole) if whole else _region(w, 0)
    r2 = _region(w, r1)
    w = _plural(w)
    if w in LEFT_ALONE:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _derived(w, r1, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else list(dict.fromkeys(map(stem, ws))))
