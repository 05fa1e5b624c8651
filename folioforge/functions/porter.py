"""The Porter stemmer (M. F. Porter, 1980, with the author's later changes), for distinct terms only."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiou"

#: The suffix tables of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ENDS = {(True, False): tuple(STEP2), (False, True): tuple(STEP3), (False, False): STEP4}

#: A word's letters as consonants and vowels; y is looked at where it stands.
_KINDS = "".join("v" if chr(i) in _VOWELS else "c" for i in range(256))


def _kinds(w: str) -> str:
    if "y" not in w:
        return w.translate(_KINDS)
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in _VOWELS or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _vowel(w: str) -> bool:
    return "v" in _kinds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(w) > 2 and _kinds(w).endswith("cvc") and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str:
    if not w.endswith(_ENDS[suffixes is STEP2, suffixes is STEP3]):
        return ""
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """The stem of a folded word; words of under three or over 63 bytes stay as they are.

    Rules see UTF-8 bytes, so a letter outside ASCII is two or more consonants.
    """
    b = w.encode()
    return w if len(b) < 3 or len(b) > 63 else _stem(b.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore")


def _stem(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, cut = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, cut = w[:-3], True
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
