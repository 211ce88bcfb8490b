"""Exact token counts with a byte-pair vocabulary, where one is at hand."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pre-splitting pattern of the public byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(ranks_path: str, pattern: str = PATTERN):
    """A function from a text column to its number of tokens (bigint), by a ranks file (base64 token, blank, rank on each
    line). The file is read once by the driver; the vocabulary, of a fixed size, goes to the workers with the function."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield s.map(lambda x: len(coder.encode_ordinary(x)) if x is not None else 1).astype("int64")

    return count


def message_tokens(content: Column, count) -> Column:
    """Exact tokens of a message with the four of its frame."""
    return count(content) + 4
