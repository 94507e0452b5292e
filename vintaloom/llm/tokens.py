"""Token counts of whole texts under a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a vocabulary file of ranks, loaded once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text (BIGINT); 0 for NULL or ''. `vocabulary` is the path of a rank file."""

    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)
