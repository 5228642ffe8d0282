"""English suffix stripping after Porter (1980), with its author's two later departures
(`bli` to `ble`, `logi` to `log`)."""

from __future__ import annotations

_VOWELS = frozenset("aeiou")

# Suffix rules of steps 2, 3 and 4, longest first within a step.
_STEP2 = (
    ("ational", "ate"),
    ("ization", "ize"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("tional", "tion"),
    ("biliti", "ble"),
    ("entli", "ent"),
    ("ousli", "ous"),
    ("ation", "ate"),
    ("alism", "al"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("alli", "al"),
    ("logi", "log"),
    ("ator", "ate"),
    ("bli", "ble"),
    ("eli", "e"),
)
_STEP3 = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ness", ""),
    ("ful", ""),
)
_STEP4 = (
    "ement",
    "ance",
    "ence",
    "able",
    "ible",
    "ment",
    "ant",
    "ent",
    "ion",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
    "al",
    "er",
    "ic",
    "ou",
)


def _shape(word: str) -> str:
    """One letter per character: `v` for a vowel, `c` for a consonant."""
    marks: list[str] = []
    for i, ch in enumerate(word):
        vowel = ch in _VOWELS or (ch == "y" and i > 0 and marks[-1] == "c")
        marks.append("v" if vowel else "c")
    return "".join(marks)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(word: str) -> str:
    for suffix, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if word.endswith(suffix):
            return word[: len(word) - cut]
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if not _has_vowel(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double_end(base) and base[-1] not in "lsz":
                return base[:-1]
            if _measure(base) == 1 and _short_end(base):
                return base + "e"
            return base
    return word


def _replace(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + new if _measure(base) > 0 else word
    return word


def _drop(word: str) -> str:
    for suffix in _STEP4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                return base
            return word
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        size = _measure(base)
        if size > 1 or (size == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; other letters and digits count as consonants.

    Words under three or over 64 bytes stay as they are.
    """
    if not 3 <= len(word.encode()) <= 64:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return _final(_drop(_replace(_replace(word, _STEP2), _STEP3)))
