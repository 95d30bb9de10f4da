"""Lengths of texts in tokens of a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut into words before merging: a fixed value that belongs to the vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file; each Python worker reads it once."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _loaded[vocabulary] = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each whole text (bigint), 0 for NULL and empty texts. Equal texts of a batch are encoded once."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            codes, distinct = pd.factorize(texts, use_na_sentinel=True)
            sizes = pd.Series([len(enc.encode_ordinary(t)) for t in distinct] + [0], dtype="int64")  # -1 is NULL
            yield sizes.iloc[codes].reset_index(drop=True)

    return count(text)
