"""English stemming by the published Porter2 algorithm, for the distinct words of a column."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words that the algorithm treats apart.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
_SAME_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
# The suffixes of steps 2, 3 and 4.
_STEP2 = {"ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"(gener|commun|arsen)", w)
    r1 = m.end() if m else (m.end() if (m := re.search(r"[aeiouy][^aeiouy]", w)) else len(w))
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem(w: str) -> str:
    """The stem of a lower-case word; words with digits, hyphens or underscores, and short ones, are left alone."""
    if len(w) <= 2 or not re.fullmatch(r"[a-z']+", w):
        return w
    if w in _SPECIAL or w in _SAME:
        return _SPECIAL.get(w, w)
    w = w.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _SAME_AFTER_1A:
        return w
    m = re.search(r"(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix, new in _STEP2.items():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for suffix, new in _STEP3.items():
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed_vocabulary(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: each word is stemmed once, whatever its count."""

    @F.pandas_udf("string")
    def run(words):
        return words.map(stem)

    return terms.select(F.col(col).alias("term")).distinct().withColumn("stem", run("term"))
