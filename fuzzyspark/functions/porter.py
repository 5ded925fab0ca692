"""Porter (1980) suffix-stripping stemmer, one word at a time.

This is a small per-word helper; Spark applies it through an Arrow-batched
pandas UDF (:func:`fuzzyspark.functions.text.stem_words`).  Words of one or
two characters are returned unchanged, as in Porter's own reference
implementation.
"""

from __future__ import annotations

from functools import lru_cache

# The rule tables of the published Porter algorithm
# (suffix -> replacement), steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_VOWELS = frozenset("aeiou")


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC){m}[V]."""
    m, i, n = 0, 0, len(stem)
    while i < n and _is_cons(stem, i):
        i += 1
    while i < n:
        while i < n and not _is_cons(stem, i):
            i += 1
        if i >= n:
            break
        while i < n and _is_cons(stem, i):
            i += 1
        m += 1
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return (n >= 3 and _is_cons(w, n - 3) and not _is_cons(w, n - 2)
            and _is_cons(w, n - 1) and w[-1] not in "wxy")


def _longest(word: str, suffixes) -> str | None:
    best = None
    for s in suffixes:
        if word.endswith(s) and (best is None or len(s) > len(best)):
            best = s
    return best


@lru_cache(maxsize=1 << 20)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = None
        if w.endswith("ed") and _has_vowel(w[:-2]):
            cut = w[:-2]
        elif w.endswith("ing") and _has_vowel(w[:-3]):
            cut = w[:-3]
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double_cons(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # step 2
    s = _longest(w, STEP2)
    if s is not None and _measure(w[: -len(s)]) > 0:
        w = w[: -len(s)] + STEP2[s]
    # step 3
    s = _longest(w, STEP3)
    if s is not None and _measure(w[: -len(s)]) > 0:
        w = w[: -len(s)] + STEP3[s]
    # step 4
    s = _longest(w, STEP4)
    if s is not None:
        base = w[: -len(s)]
        if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
            w = base
    # step 5a
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _cvc(base)):
            w = base
    # step 5b
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_text(text: str | None) -> str | None:
    """Stem every whitespace-separated word and re-join with one space."""
    if text is None:
        return None
    return " ".join(stem(t) for t in text.split())
