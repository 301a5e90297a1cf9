"""Porter's suffix stripping (An algorithm for suffix stripping, 1980), for English words in small letters."""

from __future__ import annotations

import re

# The suffixes of steps 2, 3 and 4 with what takes their place, as the paper lists them.
_STEP_2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, "
    "ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
_STEP_3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _rules(text: str) -> list[tuple[str, str]]:
    """(suffix, replacement), longest suffix first."""
    pairs = [tuple(x.strip(" ").partition(" ")[::2]) for x in text.split(",")]
    return sorted(pairs, key=lambda p: -len(p[0]))


_TWO, _THREE = _rules(_STEP_2), _rules(_STEP_3)
_FOUR = sorted(_STEP_4, key=len, reverse=True)
_RUN = re.compile("v+c+")


def _shape(word: str) -> str:
    """v or c for every letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(_RUN.findall(_shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, by in rules:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + by if _measure(rest) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        rest = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if _doubled(rest) and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest
    return word


def _last_suffix(word: str) -> str:
    for suffix in _FOUR:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            fits = _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t")))
            return rest if fits else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        m = _measure(rest)
        if m > 1 or (m == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem(word: str) -> str:
    """The stem of a word; words of one or two letters, and those with other than small English letters, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha() or not word.islower():
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_last_suffix(_replace(_replace(word, _TWO), _THREE)))
