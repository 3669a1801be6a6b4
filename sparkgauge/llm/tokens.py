"""Sizes of texts in tokens of a public byte-level tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how text is cut before merging, published with this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def widths(path: str) -> np.ndarray:
    """Bytes of each token."""
    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], dtype=np.int64)


def size_of(column: Column, path: str = TOKENIZER) -> Column:
    @F.arrow_udf(IntegerType())
    def sizes(texts: pa.Array) -> pa.Array:
        e = encoding(path)
        return pa.array([None if t is None else len(e.encode_ordinary(t)) for t in texts.to_pylist()], pa.int32())

    return sizes(column)
