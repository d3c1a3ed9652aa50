"""English suffix stripping after Porter (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of steps 2, 3 and 4 of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        out.append("v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_syllable(stem: str) -> bool:
    """Consonants, one vowel, one consonant other than w, x and y."""
    return re.fullmatch("c+vc", _shape(stem)) is not None and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s) and len(word) > len(s)]
    return max(found, key=len) if found else None


def _plural(w: str) -> str:
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 2 else w


def _past(w: str) -> str:
    if w.endswith("eed") and len(w) > 3:
        return w[:-1] if _measure(w[:-3]) > 0 else w
    suffix = next((s for s in ("ed", "ing") if w.endswith(s) and len(w) > len(s)), None)
    if suffix is None or "v" not in _shape(w[: -len(suffix)]):
        return w
    w = w[: -len(suffix)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
        return w[:-1]
    return w + "e" if _short_syllable(w) else w


def _replace(w: str, table: dict[str, str]) -> str:
    s = _longest(w, table)
    return w[: -len(s)] + table[s] if s and _measure(w[: -len(s)]) > 0 else w


def _strip(w: str) -> str:
    s = _longest(w, STEP4)
    if s:
        return w[: -len(s)] if _measure(w[: -len(s)]) > 1 else w
    if w.endswith(("sion", "tion")) and len(w) > 4 and _measure(w[:-3]) > 1:
        return w[:-3]
    return w


def _final(w: str) -> str:
    if w.endswith("e") and len(w) > 1:
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word; words under three characters stay."""
    if len(word) < 3:
        return word
    guarded = word[0] == "y"
    w = ("Y" + word[1:]) if guarded else word
    w = _past(_plural(w))
    if len(w) > 2 and w[-1] == "y" and w[-2] not in "aeiou":
        w = w[:-1] + "i"
    w = _final(_strip(_replace(_replace(w, STEP2), STEP3)))
    return "y" + w[1:] if guarded else w


@F.arrow_udf(T.StringType())
def stem_column(words: pa.Array) -> pa.Array:
    """Stems; each different word of a batch is stemmed once, and a worker remembers what it has seen."""
    coded = words.dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)
