"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published word pattern of that byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("clauseweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text, read whole; 0 for null and empty texts. ``path``: a rank file that workers can read."""

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in s], dtype="int64")

    return F.pandas_udf(sizes, "bigint")(text)
