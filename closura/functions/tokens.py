"""Token counts with a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def encoder(path: str):
    """The public byte-level BPE at ``path`` (tiktoken ranks)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text))


def token_count(path: str = VOCABULARY):
    """A column function: tokens of a text, null for null; special tokens are ordinary text."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)), na_action="ignore").astype("Int64")

    return run
