"""Sizes of texts in tokens of a public tokenizer, read from a rank file on the executors."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank file of a byte-level tokenizer; SIFTLIGHT_RANKS or the parameter names another.
RANKS = os.environ.get("SIFTLIGHT_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The pattern that splits a text before the merges of the rank file (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is encoded in parts of so many characters at most, cut before a blank.
PART = 100_000


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    """The whole text in parts; a blank before a word starts a token, so no token spans a cut there."""
    start = 0
    while len(text) - start > PART:
        cut = start + PART
        at = cut
        while at > start + 1 and not (text[at] == " " and text[at - 1] > " " and text[at + 1].isalpha()):
            at -= 1
        cut = at if at > start + 1 else cut
        yield text[start:cut]
        start = cut
    yield text[start:]


def count_tokens(text: str | None, path: str = RANKS) -> int:
    """Tokens of a text; null and empty have none."""
    if not text:
        return 0
    encode = encoding(path).encode_ordinary
    if len(text) <= PART:
        return len(encode(text))
    return sum(len(encode(part)) for part in _parts(text))


def with_tokens(df: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """``df`` with its text column replaced by ``tokens`` (long); every text is read whole.

    Null and empty texts have 0 tokens; a column ``tokens`` that is already there is replaced.
    """
    kept = [c for c in df.columns if c not in (text, "tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([count_tokens(t, path) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), n], names=[*kept, "tokens"])

    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in kept), "tokens long"])
    return df.select(*kept, text).mapInArrow(count, schema)
