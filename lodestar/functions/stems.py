"""Stems of English and Russian words, after the public descriptions of the Snowball algorithms.

A word's alphabet tells its language. The stemmers are small per-word helpers; Spark applies them to batches of token arrays.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithms' endings and exceptions.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
RU_VOWELS = "аеиоуыэюя"
RU_GERUND = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
RU_ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
RU_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
RU_VERB = (
    "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split(),
    "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split(),
)
RU_NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()


def _region(word: str, vowels: str) -> int:
    """Where the part behind the first non-vowel after a vowel begins."""
    for k in range(1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def _longest(word: str, endings) -> str | None:
    return max((x for x in endings if word.endswith(x)), key=len, default=None)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def english(word: str) -> str:
    """The stem of a lower-case English word."""
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) < 3:
        return word
    w = re.sub(r"('s'|'s|')$", "", word.removeprefix("'"))
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    first = next((len(x) for x in ("gener", "commun", "arsen") if w.startswith(x)), None) or _region(w, VOWELS)
    second = first + _region(w[first:], VOWELS)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(x in VOWELS for x in w[:-2]):
        w = w[:-1]
    if w in FINISHED:
        return w
    # 1b
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= first else w
    elif end and any(x in VOWELS for x in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")) or _short_end(w) and first >= len(w):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    end = _longest(w, SECOND)
    if end and len(w) - len(end) >= first and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] and w[-3] in "cdeghkmnrt"):
        w = w[: -len(end)] + SECOND[end]
    # 3
    end = _longest(w, THIRD)
    if end and len(w) - len(end) >= (second if end == "ative" else first):
        w = w[: -len(end)] + THIRD[end]
    # 4
    end = _longest(w, FOURTH)
    if end and len(w) - len(end) >= second and (end != "ion" or w[-4:-3] and w[-4] in "st"):
        w = w[: -len(end)]
    # 5
    if w.endswith("e") and (len(w) > second or len(w) > first and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.replace("Y", "y")


def _cut(word: str, start: int, endings, after: str = "") -> str | None:
    """The word without the longest of some endings in its region, behind one of the letters `after` if given."""
    found = _longest(word[start:], endings)
    if found is None or after and not (len(word) - len(found) > start and word[-len(found) - 1] in after):
        return None
    return word[: -len(found)]


def _of_two(word: str, start: int, groups) -> str | None:
    """Endings of the first group count behind а or я. The longest ending of both decides."""
    found = max((x for g in groups for x in g if word[start:].endswith(x)), key=len, default=None)
    if found is None:
        return None
    return _cut(word, start, [found], "" if found in groups[1] else "ая")


def russian(word: str) -> str:
    """The stem of a lower-case Russian word."""
    w = word.replace("ё", "е")
    start = next((k + 1 for k, x in enumerate(w) if x in RU_VOWELS), len(w))
    first = _region(w, RU_VOWELS)
    second = first + _region(w[first:], RU_VOWELS)
    cut = _of_two(w, start, RU_GERUND)
    if cut is None:
        w = _cut(w, start, ("ся", "сь")) or w
        cut = _cut(w, start, RU_ADJECTIVE)
        if cut is not None:
            cut = _of_two(cut, start, RU_PARTICIPLE) or cut
        else:
            cut = _of_two(w, start, RU_VERB)
            if cut is None:
                cut = _cut(w, start, RU_NOUN)
    w = w if cut is None else cut
    w = w[:-1] if len(w) > start and w.endswith("и") else w
    w = _cut(w, second, ("ость", "ост")) or w
    longest = _cut(w, start, ("ейше", "ейш"))
    w = longest if longest is not None else w
    if w.endswith("нн") and len(w) - 1 > start:
        return w[:-1]
    return w[:-1] if longest is None and w.endswith("ь") and len(w) > start else w


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """By its letters a word is English, Russian, or neither; such are left as they are."""
    if re.fullmatch(r"[a-z']+", word):
        return english(word)
    return russian(word) if re.fullmatch(r"[а-яё]+", word) else word


def _stemmed(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda own: None if own is None else [stem(x) for x in own])


def stems(tokens: Column) -> Column:
    """Lower-case tokens as stems, one by one."""
    return F.pandas_udf(_stemmed, "array<string>").asNondeterministic()(tokens)
