"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern that belongs to the byte-level vocabularies (a fixed value of theirs).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The file of a multilingual byte-level vocabulary on this machine; on a cluster all machines need the same path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, key: str, columns: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key``, ``columns`` and ``n_tokens`` of every row; a null text has 0 tokens. The text itself isn't kept."""
    path = vocabulary or default_vocabulary()
    kept = [key, *columns]
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            out = batch[kept].copy()
            out["n_tokens"] = [0 if t is None else len(encode(t)) for t in batch["__text"]]
            yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_tokens long"
    return documents.select(*kept, F.col(text).alias("__text")).mapInPandas(run, schema)
