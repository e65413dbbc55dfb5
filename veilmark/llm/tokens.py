"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A byte-level BPE vocabulary as ranks; any other file of that format can be given instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The encoder of a rank file, built once a process."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def n_tokens(text: Column, path: str = TOKENIZER, pattern: str = PATTERN) -> Column:
    """Tokens of a text; null for null, 0 for an empty one. Strings of special tokens count as ordinary text."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path, pattern).encode_ordinary
        for values in batches:
            yield pd.Series([None if v is None else len(encode(v)) for v in values], dtype="Int32")

    return count(text)
