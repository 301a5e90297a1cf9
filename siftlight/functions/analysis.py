"""Text analysis, one definition for index and query side.

Lower-case, split into runs of letters, marks and digits (an inner apostrophe joins), Han and kana signs
one by one, strip an English possessive, drop stopwords, stem. Positions count every token before stopwords
are dropped, so a gap stays where one stood. An ``Analyzer`` says which of the steps are done.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siftlight.functions.porter import stem

# The stop set of the analyzer.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there "
    "these they this to was will with"
).split()

_SINGLE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
_WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"
_POSSESSIVE = r"['’]s$"
#: Where the scripts of single signs begin.
_HIGH = r"[\x{2e80}-\x{10ffff}]"

_high = re.compile("[\u2e80-\U0010ffff]")
_single = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_word = regex.compile(_WORD)
_possessive = regex.compile(_POSSESSIVE)
_stop = frozenset(STOPWORDS)


@F.pandas_udf(ArrayType(StringType()))
def _stemmed(words: pd.Series, keep: pd.Series) -> pd.Series:
    """Stems of arrays of words, each distinct word of a batch worked out once; words in ``keep`` stay."""
    stay = frozenset(keep.iloc[0]) if len(keep) else frozenset()
    known: dict[str | None, str | None] = {None: None}
    for w in {w for row in words if row is not None for w in row if w is not None}:
        known[w] = w if w in stay else stem(w)
    return words.map(lambda row: None if row is None else [known[w] for w in row])


@dataclass(frozen=True)
class Analyzer:
    """``stemmer`` is none or porter; words in ``unstemmed`` are left as they are, in the form before the stemmer."""

    lowercase: bool = True
    stop: bool = True
    stemmer: str = "none"
    unstemmed: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.stemmer not in ("none", "porter"):
            raise ValueError(f"unknown stemmer {self.stemmer!r}")

    def describe(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, described: dict) -> Analyzer:
        return cls(**{**described, "unstemmed": tuple(described["unstemmed"])})

    def words(self, text: Column) -> Column:
        """Array of the words of a text before stopwords are dropped and without stems; null and empty texts have none."""
        whole = F.coalesce(text, F.lit(""))
        # both replacements are left out where the text has nothing for them; most texts don't
        spaced = F.when(whole.rlike(_HIGH), F.regexp_replace(whole, f"({_SINGLE})", " $1 ")).otherwise(whole)
        found = F.regexp_extract_all(F.lower(spaced) if self.lowercase else spaced, F.lit(_WORD), F.lit(0))
        stripped = F.transform(found, lambda w: F.regexp_replace(w, _POSSESSIVE, ""))
        return F.when(whole.rlike("['’][sS]"), stripped).otherwise(found)

    def dropped(self, word: Column) -> Column:
        """Whether a word leaves only a gap."""
        return (is_stop(word) | (word == "")) if self.stop else word == ""

    def kept(self, text: Column) -> Column:
        """Array of the terms of a text, null where a word leaves a gap; an entry's place is its position."""
        marked = F.transform(self.words(text), lambda w: F.when(~self.dropped(w), w))
        if self.stemmer == "none":
            return marked
        return _stemmed(marked, F.array(*map(F.lit, self.unstemmed)) if self.unstemmed else F.expr("cast(array() as array<string>)"))

    def tokenize(self, text: str) -> list[str]:
        """``words`` for one string."""
        spaced = _single.sub(r" \g<0> ", text) if not text.isascii() and _high.search(text) else text
        found = _word.findall(spaced.lower() if self.lowercase else spaced)
        return [_possessive.sub("", w) for w in found] if "'" in text or "’" in text else found

    def query_term(self, word: str) -> str | None:
        """The term of a query word: its first token, None for a stopword or a word without token."""
        got = self.tokenize(word)
        if not got or (self.stop and got[0] in _stop):
            return None
        return got[0] if self.stemmer == "none" or got[0] in self.unstemmed else stem(got[0])


DEFAULT = Analyzer()


def tokens(text: Column) -> Column:
    """Array of the tokens of a text under the default analyzer, stopwords included."""
    return DEFAULT.words(text)


def is_stop(token: Column) -> Column:
    return token.isin(STOPWORDS)


def tokenize(text: str) -> list[str]:
    """``tokens`` for one string on the driver."""
    return DEFAULT.tokenize(text)


def query_term(word: str) -> str | None:
    """The term of a query word under the default analyzer."""
    return DEFAULT.query_term(word)
